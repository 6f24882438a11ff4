"""Trailing counts by sweep against counting pair by pair, and their spread over tasks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cellarmark.operators import request_log

LOG = "service string, ts timestamp, event_id long"
START = dt.datetime(2024, 1, 1)


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), START + dt.timedelta(seconds=rng.randrange(90), microseconds=rng.randrange(2)), n) for n in range(300)]
    rows += [("a", None, 300), rows[0], ("lone", START, 301), ("a", START - dt.timedelta(days=400000), 302)]
    got = request_log.trailing_counts(spark.createDataFrame(rows, LOG), 10, "n")
    span = dt.timedelta(seconds=10)
    want = [(s, t, e, None if t is None else sum(1 for a, b, _ in rows if a == s and b is not None and t - span < b <= t)) for s, t, e in rows]
    assert got.columns == ["service", "ts", "event_id", "n"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert request_log.trailing_counts(spark.createDataFrame([], LOG), 10, "n").count() == 0


def test_one_service_in_one_hour_spreads(spark):
    log = spark.range(20000).select(F.lit("hot").alias("service"), F.timestamp_micros(F.col("id") * 170_000).alias("ts"), F.col("id").alias("event_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = request_log.running_counts(log, 3600).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["n"] for r in placed) == 20000 and len(placed) >= 6 and max(r["n"] for r in placed) < 20000 / 2.5
