"""The rule cascades against the sequential walk over all pairs, short names and shared makers included."""

import random

import pytest
from pyspark.sql import functions as F

from cellarmark.operators import resolution
from cellarmark.operators.clustering import default_order

SCHEMA = """name string, up string, class_types array<string>, producers array<string>, primary array<string>, first_producer string,
    white_label boolean, white_label_candidate boolean, stores array<string>, core string"""
NAMES = ["NA", "VINA QUIXZY BROOK", "XO", "XO GRAND RESERVE", "X", "AXOLOTL", "GLENFIDDICH", "GLENFIDICH", "FOX", "FOX HILL", "FOXHILL 2", "OWL", "OWLS", "Q", "QUARTZ CREEK", "QUARTZ CREEKS", "COSTCO RYE", "COSTCO RYES", "", "RIVER", "RIVERS BEND", "BEND RIVER"]


def features(spark, seed):
    rng = random.Random(seed)
    rows = []
    for name in NAMES:
        makers = sorted(rng.sample(["P1", "P2", "P3"], rng.randint(0, 2)))
        white = name.startswith("COSTCO")
        rows.append((name, name.upper(), rng.sample(["gin", "rum"], rng.randint(0, 2)), makers, makers[:1], rng.choice(["M1", "M2", None]), white, white or rng.random() < 0.2, ["COSTCO"] if white else [], rng.choice([name, name.split(" ")[0]])))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1])
@pytest.mark.parametrize("producer_aware", [False, True])
def test_equals_the_walk(spark, producer_aware, seed):
    nodes = features(spark, seed).withColumn("ord", F.col("name") if producer_aware else default_order()).cache()
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    ratio = lambda x, y: resolution.ratcliff_ratio(x, y)
    core, name = ratio(a("core"), b("core")), resolution._boosted(ratio(a("up"), b("up")), a("up"), b("up"))
    boosted = resolution._boosted(core, a("core"), b("core"))
    score = resolution.producer_cascade_score(a, b, boosted, name) if producer_aware else resolution.cascade_score(a, b, core, name)
    pairs = nodes.alias("a").join(nodes.alias("b"), F.col("a.ord") < F.col("b.ord")).select(a("name").alias("x"), b("name").alias("y"), score.alias("s"))
    linked = {(r["x"], r["y"]) for r in pairs.collect() if r["s"] >= (0.5 if producer_aware else 0.6) - 1e-12}
    want = {}
    for n in [r["name"] for r in nodes.orderBy("ord").collect()]:
        want[n] = next((m for m in want if want[m] == m and (m, n) in linked), n)
    got = {r["name"]: r["leader"] for r in resolution.cascade_clusters(nodes.drop("ord"), producer_aware).collect()}
    assert got == want
    assert any(k != v for k, v in got.items())


def test_contained_short_core_is_found(spark):
    rows = [(n, n, [], ["P"], ["P"], None, False, False, [], n) for n in ("NA", "VINA QUIXZY BROOK")]
    for aware in (False, True):
        got = {r["name"]: r["leader"] for r in resolution.cascade_clusters(spark.createDataFrame(rows, SCHEMA), aware).collect()}
        assert len(set(got.values())) == 1, (aware, got)
