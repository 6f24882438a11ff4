"""Candidate keys against all pairs: no similar pair may be lost."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cellarmark.functions import candidates
from cellarmark.operators import contacts, resolution

NAMES = ["JOHNSON", "JONSSON", "ROTHSCHILD", "BOTHSCHILT", "BLUEFOXES", "BLUEFOX", "FOX", "A", "", "LA FOX 7", "GLENFIDDICH", "GLENFIDICH", "ELM SELECT", "Elm"]


def random_names(n, seed=2):
    rng = random.Random(seed)
    base = ["".join(rng.choices("ABCDEILNORST ", k=rng.randint(3, 14))).strip() or "X" for _ in range(n)]
    return sorted({*NAMES, *base, *("".join(c for c in b if rng.random() > 0.15) or "Y" for b in base)})


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9])
def test_similar_names_share_a_key(spark, threshold):
    names = random_names(60)
    df = spark.createDataFrame([(n,) for n in names], "n string")
    keys = {r["n"]: set(r["k"]) for r in df.select("n", candidates.ratio_keys(df.n, threshold).alias("k")).collect()}
    missed = [(a, b) for a, b in itertools.permutations(names, 2) if a and ratio(a, b) >= threshold and not keys[a] & keys[b]]
    assert not missed


def test_contained_names_share_a_key(spark):
    names = [n for n in random_names(60) if n]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = {r["n"]: (r["lead"], set(r["all"])) for r in df.select("n", candidates.lead_key(df.n).alias("lead"), candidates.substring_keys(df.n).alias("all")).collect()}
    assert all(rows[b][0] in rows[a][1] for a in names for b in names if b in a)


def test_contact_matches_equal_all_pairs(spark):
    companies, brands = random_names(40, 5), random_names(40, 6)
    got = contacts.match_contacts(spark.createDataFrame([(n,) for n in companies], "company_name string"), spark.createDataFrame([(n,) for n in brands], "brand_name string"))
    got = {r["company_name"]: (r["brand_name"], r["stage"]) for r in got.collect()}
    want = {}
    for c in companies:
        up = c.upper().strip()
        same = [b for b in brands if b.upper().strip() == up]
        fuzzy = sorted((-ratio(up, b.upper().strip()), b) for b in brands if up and b and ratio(up, b.upper().strip()) >= 0.8)
        held = sorted((-ratio(up, b.upper().strip()), b) for b in brands if up and b and (up in b.upper() or b.upper() in up))
        if same:
            want[c] = (min(same), "exact")
        elif fuzzy:
            want[c] = (fuzzy[0][1], "fuzzy")
        elif held:
            want[c] = (held[0][1], "contains")
    assert got == want


def test_fuzzy_clusters_equal_the_sequential_walk(spark):
    names = [n for n in random_names(50, 8) if n]
    got = resolution.fuzzy_name_clusters(spark.createDataFrame([(n,) for n in names], "brand_name string"))
    got = {r["name"]: r["leader"] for r in got.collect()}
    want = {}
    for n in sorted(names, key=lambda x: (len(x), x)):
        lead = next((m for m in sorted(names, key=lambda x: (len(x), x)) if want.get(m) == m and ratio(m.upper().strip(), n.upper().strip()) > 0.8), None)
        want[n] = lead or n
    assert got == want
    assert got["JONSSON"] == got["JOHNSON"]


def test_feedback_counts_each_group_once(spark):
    names = spark.createDataFrame([("Alpha Reserve",), ("Bravo Cellars",), ("Zulu",)], "brand_name string")
    feedback = spark.createDataFrame([(1, "approved", ["Alpha Reserve", "Q"]), (2, "rejected", ["Bravo Cellars", "R"]), (3, "approved", ["Bravo Cellar", "Alpha Reserve"])], "feedback_id long, user_action string, brand_group array<string>")
    got = resolution.feedback_adjustment(names, feedback)
    ids = {r["brand_name"]: (sorted(r["approved"]), sorted(r["rejected"])) for r in got.collect()}
    assert ids == {"Alpha Reserve": ([1, 3], []), "Bravo Cellars": ([3], [2])}
    pair = got.alias("a").join(got.alias("b"))
    shift = resolution.pair_adjustment(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    assert pair.filter("a.brand_name < b.brand_name").select(shift.alias("s")).first()["s"] == 0.0


def test_merge_chains_are_followed(spark):
    approved = spark.createDataFrame([("p1", "B", 1, 0.9), ("p2", "C", 1, 0.9), ("p3", "X", 1, 0.9), ("p4", "Y", 1, 0.9)], "proposal_id string, canonical_name string, source_priority int, confidence double")
    members = spark.createDataFrame([("p1", "A"), ("p1", "B"), ("p2", "B"), ("p2", "C"), ("p3", "Y"), ("p4", "X")], "proposal_id string, brand_name string")
    got = {r["brand_name"]: r["canonical_name"] for r in resolution.merge_mapping(approved, members).collect()}
    assert got == {"A": "C", "B": "C"}
