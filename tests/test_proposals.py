"""From clusters to proposals, approval and merged tables on a small registry."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cellarmark.functions import names as N
from cellarmark.operators import resolution, upserts

NAMES = ["RED OAK", "RED OAK WINERY", "RED OAK RESERVE", "BLUE FOX 2019", "BLUE FOX 2020", "STONE"]


def brands(spark):
    rows = [(n, None, ["France"], ["WINE"], 0.5, 0.8, i + 1) for i, n in enumerate(NAMES)]
    schema = "brand_name string, url string, countries array<string>, class_types array<string>, confidence double, completeness double, sku_count long"
    return spark.createDataFrame(rows, schema)


def test_similarity_proposals_to_merged_labels(spark):
    b = brands(spark)
    clusters = resolution.similar_brand_clusters(b, heads=2)
    proposals, members = resolution.similarity_proposals(clusters, b)
    found = {r["canonical_name"]: r["brands_to_merge"] for r in proposals.collect()}
    assert found == {"RED OAK RESERVE": 2, "BLUE FOX 2019": 1}
    report = resolution.opportunities([proposals])
    kinds = {r["kind"] for r in resolution.approvals(report).collect()}
    assert kinds == {"similarity"}
    mapping = resolution.merge_mapping(report, members)
    skus = b.select(F.explode(F.sequence(F.lit(1), F.col("sku_count"))).alias("i"), "brand_name").withColumn("ttb_id", F.concat_ws("-", "brand_name", "i"))
    moved = upserts.rekey_skus(skus, mapping)
    assert moved.count() == skus.count()
    assert {r[0] for r in moved.select("brand_name").distinct().collect()} == {"RED OAK RESERVE", "BLUE FOX 2019", "STONE"}


def test_predicted_clusters_equal_sequential_loop(spark):
    def typed(a, b):
        kind = kinds.get((a, b))
        return score[kind] if kind else SequenceMatcher(None, a.lower(), b.lower()).ratio()

    order = sorted(NAMES, key=lambda n: (len(n), n))
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(order) for b in order[i + 1 :]], "a string, b string")
    got = pairs.select("a", "b", N.variation_type(F.col("a"), F.col("b")).alias("k")).collect()
    kinds = {(r["a"], r["b"]): r["k"] for r in got}
    from cellarmark.rules import VARIATION_SCORES as score

    want = {}
    for i, a in enumerate(order):
        if a in want:
            continue
        want[a] = a
        for b in order[i + 1 :]:
            if b not in want and typed(a, b) >= 0.6:
                want[b] = a
    out = resolution.predicted_clusters(brands(spark), heads=2).collect()
    assert {r["name"]: r["leader"] for r in out} == want


def test_fuzzy_proposals(spark):
    b = brands(spark)
    proposals, members = resolution.fuzzy_proposals(resolution.fuzzy_name_clusters(b, heads=2), b)
    rows = {r["canonical_name"]: round(r["confidence"], 2) for r in proposals.collect()}
    assert rows == {"BLUE FOX 2019": 0.8} and [r["brand_name"] for r in members.collect()] == ["BLUE FOX 2020"]
