"""Clusters equal the sequential greedy loop."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cellarmark.functions.names import significant_words
from cellarmark.functions.similarity import levenshtein_similarity, ratcliff_ratio, ratio_upper_bound
from cellarmark.operators import resolution
from cellarmark.operators.clustering import default_order, greedy_clusters, name_blocks


def sequential(names, similar):
    free, leader = sorted(names, key=lambda n: (len(n), n)), {}
    for i, a in enumerate(free):
        if a in leader:
            continue
        leader[a] = a
        for b in free[i + 1 :]:
            if b not in leader and similar(a, b):
                leader[b] = a
    return leader


def random_names(seed, n):
    rng = random.Random(seed)
    vocabulary = ["RED", "BLUE", "OAK", "HILL", "RIVER", "STONE", "FOX", "CREEK"]
    return sorted({" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) + rng.choice(["", " 1", " 22", "S"]) for _ in range(n)})


def share_word(a, b):
    wa, wb = ({w for w in x.split() if len(w) >= 3} for x in (a, b))
    return bool(wa & wb)


def run(spark, names, heads, exact, bound, threshold):
    nodes = spark.createDataFrame([(n,) for n in names], "name string").withColumn("ord", default_order())
    blocks = name_blocks(nodes, significant_words(F.col("name")))
    out = greedy_clusters(
        nodes, blocks, lambda a, b: bound(a("name"), b("name")) >= threshold - 1e-9, lambda a, b: exact(a("name"), b("name")), threshold, heads=heads
    )
    return {r["name"]: r["leader"] for r in out.collect()}


def test_ratio_clusters_equal_sequential_loop(spark):
    names = random_names(1, 120)
    want = sequential(names, lambda a, b: share_word(a, b) and SequenceMatcher(None, a, b).ratio() >= 0.7)
    # two heads per block force many rounds, late leaders and re-assignments
    assert run(spark, names, 2, ratcliff_ratio, ratio_upper_bound, 0.7) == want


def test_levenshtein_clusters_equal_sequential_loop(spark):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev if x == y else 1 + min(prev, row[j], row[j - 1])
        return row[-1]

    names = random_names(2, 120)
    sim = lambda a, b: (max(len(a), len(b)) - lev(a, b)) / max(len(a), len(b))
    want = sequential(names, lambda a, b: share_word(a, b) and sim(a, b) >= 0.6)
    assert run(spark, names, 3, levenshtein_similarity, levenshtein_similarity, 0.6) == want


def test_average_similarity_counts_every_pair(spark):
    names = random_names(3, 60)
    frame = spark.createDataFrame([("g", n) for n in names] + [("one", "SOLO")], "group_id string, name string")
    got = resolution.average_similarity(frame, chunk=7).collect()
    pairs = [SequenceMatcher(None, a, b).ratio() for i, a in enumerate(names) for b in names[i + 1 :]]
    assert len(got) == 1 and got[0]["comparisons"] == len(pairs)
    assert abs(got[0]["average_similarity"] - sum(pairs) / len(pairs)) < 1e-9


def test_brand_clusters_keep_every_brand(spark):
    names = ["RED OAK WINERY", "RED OAK", "RED OAK RESERVE", "BLUE FOX", "BLUE FOX CREEK", "STONE"]
    rows = [(n, None, ["France"], ["WINE"]) for n in names]
    brands = spark.createDataFrame(rows, "brand_name string, url string, countries array<string>, class_types array<string>")
    got = {r["name"]: r["leader"] for r in resolution.similar_brand_clusters(brands).collect()}
    assert set(got) == set(names)
    assert got["RED OAK WINERY"] == "RED OAK" and got["BLUE FOX CREEK"] == "BLUE FOX" and got["STONE"] == "STONE"


def test_each_pair_is_scored_once(spark, monkeypatch):
    from cellarmark.operators import clustering

    scored, cut = [], clustering.cut_lineage

    def counted(df):
        out = cut(df)
        if "_own" in out.columns and "score" in out.columns:
            scored.append(out.count())
        return out

    monkeypatch.setattr(clustering, "cut_lineage", counted)
    names = random_names(4, 150)
    nodes = spark.createDataFrame([(n,) for n in names], "name string").withColumn("ord", default_order())
    # nothing is ruled out beforehand and every name has the same dozen blocks
    blocks = name_blocks(nodes, F.array(*[F.lit(str(k)) for k in range(12)]))
    out = greedy_clusters(nodes, blocks, lambda a, b: F.lit(True), lambda a, b: ratcliff_ratio(a("name"), b("name")), 0.6, heads=16)
    found = {r["name"]: r["leader"] for r in out.collect()}
    want = sequential(names, lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.6)
    leaders = len(set(want.values()))
    assert found == want
    assert 0 < sum(scored) <= leaders * len(names) + len(names) ** 2 / 2


def test_typed_average_counts_rules_and_repeats(spark):
    from cellarmark import rules
    from cellarmark.functions.names import variation_type

    names = [*random_names(5, 40), "RED OAK 2019", "RED OAK 2020", "RED OAK WINERY", "RED OAK", "RED OAK RESERVE", "RED OAK"]
    pairs = [(min(a, b), max(a, b)) for i, a in enumerate(names) for b in names[i + 1 :] if a != b]
    df = spark.createDataFrame(sorted(set(pairs)), "a string, b string")
    kinds = {(r["a"], r["b"]): r["k"] for r in df.select("a", "b", variation_type(F.col("a"), F.col("b")).alias("k")).collect()}
    scores = [rules.VARIATION_SCORES[kinds[p]] if kinds[p] else SequenceMatcher(None, p[0].lower(), p[1].lower()).ratio() for p in pairs]
    frame = spark.createDataFrame([("g", n) for n in names] + [("same", "SOLO"), ("same", "SOLO")], "group_id string, name string")
    got = {r["group_id"]: r for r in resolution.average_similarity(frame, chunk=7, typed=True).collect()}
    assert sum(k is not None for k in kinds.values()) >= 3
    assert got["g"]["comparisons"] == len(pairs) and abs(got["g"]["average_similarity"] - sum(scores) / len(scores)) < 1e-9
    assert got["same"]["comparisons"] == 0 and got["same"]["average_similarity"] is None
