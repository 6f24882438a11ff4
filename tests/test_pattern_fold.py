"""The clamped fold of one hot pattern on one day, against a loop."""

from pyspark.sql import functions as F

from cellarmark.operators import learning


def looped(good, start):
    value = start
    for g in good:
        value = min(1.0, value + 0.05) if g else max(0.1, value - 0.1)
    return round(value, 6)


def test_a_million_steps_of_one_pattern_on_one_day(spark):
    n = 1_000_000
    rank = (F.col("id") * 7919) % n  # rows come in another order than their times
    steps = spark.range(n).select(
        F.lit("hot").alias("pattern"), F.timestamp_micros(rank).alias("ts"), rank.alias("event_id"), ((rank * rank) % 7 < 4).alias("success"), F.lit(0.5).alias("start"),
    )
    few = steps.filter("event_id < 9").withColumn("pattern", F.lit("few"))
    got = {r["pattern"]: tuple(r)[1:] for r in learning.pattern_fold(steps.unionByName(few)).collect()}
    good = [k * k % 7 < 4 for k in range(n)]
    assert got == {
        "hot": (sum(good), n - sum(good), looped(good, 0.5)),
        "few": (sum(good[:9]), 9 - sum(good[:9]), looped(good[:9], 0.5)),
    }
    assert learning.pattern_fold(steps.limit(0)).count() == 0
