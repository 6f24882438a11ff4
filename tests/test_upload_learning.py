"""Upload learning against the pair-by-pair loop over all kinds of variation."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from test_candidates import random_names

from cellarmark import rules
from cellarmark.functions import candidates
from cellarmark.operators import learning
from cellarmark.session import shared_folder

OLD = ["FOX", "GLENFIDDICH", "ELM", "Oak 2019", "OWL CALIFORNIA", "HILL WHISKEY CO", "RIVER RESERVE", "SMITH AND SONS", "KELLER COMPANY", "BLUE  MOON", "A", "ab", " PADDED ", "ORCHARD LANE WINERY", "x"]
NEW = ["FOX SPIRITS", "GLENFIDICH", "Elm", "oak 2021", "OWL", "HILL WHISKY CO", "RIVER", "SMITH & SONS", "KELLER CO", "BLUE MOON SELECT", "B", "AB", "PADDED", "ORCHARD LANE", "FOX", "OWL KENTUCKY", "X", "Oak", "ORCHARD LANES WINERY 9"]
PATTERNS = [("fuzzy_match", "ORCH", 0.9, 3, 1), ("fuzzy_match", "", 0.2, 1, 3), ("exact", "glenf", 0.8, 1, 0), ("year_variation", "", 1.0, 5, 0), ("fuzzy_match", "lane", 1.0, 4, 0), ("fuzzy_match", "LANE", 0.5, 4, 0)]


def kind_of(a, b):
    """The first rule that two lower-cased trimmed names meet."""
    def bare(pattern, x):
        return " ".join(re.sub(pattern, "", x).split())

    if a == b:
        return "exact"
    year = rules.YEAR_PATTERN
    if re.search(year, a) and re.search(year, b) and re.sub(year, "", a).strip() == re.sub(year, "", b).strip() != "":
        return "year_variation"
    if any(a.replace(p, "").strip() == b.replace(p, "").strip() != "" for p in rules.LOCATION_WORDS):
        return "location_variation"
    for s in rules.BRAND_SUFFIXES:
        for x, y in ((a, b), (b, a)):
            if x.endswith(s) and not y.endswith(s) and x.replace(s, "").strip() == y:
                return "suffix_variation"
    for full, shorts in rules.NAME_ABBREVIATIONS.items():
        for short in shorts:
            x, y = (a, b) if full in a and short in b else (b, a)
            if full in x and short in y and x.replace(full, short) == y:
                return "abbreviation"
    if bare(rules.EDITION_PATTERN, a) == bare(rules.EDITION_PATTERN, b) != "":
        return "special_edition"
    return None


def pairs_of(new, old, patterns=()):
    found = {}
    for n in set(new) - set(old):
        for o in set(old):
            a, b = n.lower().strip(), o.lower().strip()
            kind = kind_of(a, b)
            gain = sum(c * ok / max(ok + bad, 1) * 0.1 for t, base, c, ok, bad in patterns if (t == "exact" or t not in rules.VARIATION_SCORES) and (base.lower() in n.lower() or base.lower() in o.lower()))
            score = rules.VARIATION_SCORES[kind] if kind else min(1.0, SequenceMatcher(None, a, b).ratio() + min(gain, 0.3))
            if score >= 0.7:
                m = SequenceMatcher(None, o.lower(), n.lower()).find_longest_match(0, len(o), 0, len(n))
                found[n, o] = (round(score, 9), kind or "fuzzy_match", o[m.a : m.a + m.size] if m.size > 3 else "")
    return found


def frame(spark, names):
    return spark.createDataFrame([(n, 1, "k") for n in names], "brand_name string, _key int, kind string")


def rows(df):
    return {(r["new_brand"], r["existing_brand"]): (round(r["similarity"], 9), r["pattern_type"], r["base_pattern"]) for r in df.collect()}


@pytest.mark.parametrize("patterns", [(), PATTERNS])
def test_all_kinds_equal_the_loop(spark, patterns):
    new, old = [*NEW, *random_names(25, 3)], [*OLD, *(n for n in random_names(25, 4) if n not in NEW)]
    known = spark.createDataFrame(patterns, "pattern_type string, base_pattern string, confidence double, success_count long, failure_count long") if patterns else None
    got = rows(learning.upload_variations(frame(spark, [*new, *new, None]), frame(spark, [*old, None]), known))
    want = pairs_of(new, old, patterns)
    assert got == want
    kinds = {k for _, k, _ in want.values()}
    assert kinds >= {*rules.VARIATION_SCORES, "fuzzy_match"}
    assert {("FOX SPIRITS", "FOX"), ("GLENFIDICH", "GLENFIDDICH"), ("Elm", "ELM")} <= set(got)


def test_empty_sides(spark):
    assert rows(learning.upload_variations(frame(spark, []), frame(spark, OLD))) == {}
    assert rows(learning.upload_variations(frame(spark, NEW), frame(spark, []))) == {}
    assert rows(learning.upload_variations(frame(spark, OLD), frame(spark, OLD))) == {}


def test_patterns_fold_and_go_on(spark):
    pairs = learning.upload_variations(frame(spark, NEW), frame(spark, OLD))
    want = {}
    for (n, o), (score, kind, base) in sorted(pairs_of(NEW, OLD).items()):
        if (kind, base) in want:
            c, ok, *first = want[kind, base]
            want[kind, base] = (min(1.0, c + 0.05), ok + 1, *first)
        else:
            want[kind, base] = (score, 1, o, n)
    first = learning.learned_patterns(pairs)
    as_dict = lambda df: {(r["pattern_type"], r["base_pattern"]): (round(r["confidence"], 9), r["success_count"], r["first_existing"], r["first_new"]) for r in df.collect()}
    assert as_dict(first) == {k: (round(c, 9), *rest) for k, (c, *rest) in want.items()}
    again = as_dict(learning.learned_patterns(pairs.filter(F.col("pattern_type") == "year_variation"), first))
    assert {k: v[1] for k, v in again.items()} == {k: v[1] * (2 if k[0] == "year_variation" else 1) for k, v in want.items()}


def test_replayed_upload_adds_nothing(spark):
    log = f"{shared_folder(spark)}/upload-log"
    want = pairs_of(NEW, OLD)
    assert rows(learning.learn_from_upload(frame(spark, NEW), frame(spark, OLD), log, "u1")) == want
    learning.learn_from_upload(frame(spark, NEW), frame(spark, OLD), log, "u1")
    learning.learn_from_upload(frame(spark, NEW[:1]), frame(spark, OLD), log, "u2")
    logged = spark.read.parquet(log)
    assert logged.filter("upload_id = 'u1'").count() == len(want)
    assert logged.filter("upload_id = 'u2'").count() == len(pairs_of(NEW[:1], OLD))


def test_short_texts_share_a_key_with_longer_ones(spark):
    names = ["NA", "VINA QUIXZY BROOK", "X", "XO", "XO GRAND RESERVE", "AXOLOTL", "BROOK"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    keys = {r["n"]: set(r["k"]) for r in df.select("n", candidates.joint_keys(df.n, 1.0).alias("k")).collect()}
    assert all(keys[a] & keys[b] for a in names for b in names if a in b)
