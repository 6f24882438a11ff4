"""Pairs of names that differ by digits only: one ratio for a kind of pairs, counted as often as the kind has pairs."""

import random
from difflib import SequenceMatcher

import pandas as pd

from cellarmark.functions import similarity
from cellarmark.operators import resolution


def test_kinds_of_pairs_count_as_the_pairs_do(spark):
    rng = random.Random(3)
    names = [f"OLD ROD {rng.randint(0, 240)}{w}{rng.randint(1, 25)}" for w in (" WINERY ", " ", " RESERVE 20") for _ in range(25)]
    names += ["1234567890123", "A 1\x002", "A 1\x003", "X" * 101 + "1", "X" * 101 + "2", "", "OLD ROD 7 ١", *names[:2]]
    pairs = [(min(a, b), max(a, b)) for n, a in enumerate(names) for b in names[n + 1 :] if a != b]
    want = sum(SequenceMatcher(None, a, b).ratio() for a, b in pairs)
    asked, ratios = [], similarity.sequence_ratios
    similarity.sequence_ratios = lambda a, b: asked.append(len(a)) or ratios(a, b)
    try:
        one = similarity.ratio_totals.func(*(pd.Series([v]) for v in (names, names, names, names, True)))
    finally:
        similarity.sequence_ratios = ratios
    assert one["pairs"][0] == len(pairs) and abs(one["total"][0] - want) < 1e-6
    assert sum(asked) < 0.9 * len(pairs)
    frame = spark.createDataFrame([("g", n) for n in names], "group_id string, name string")
    for chunk in (5, 64, 1024):
        got = resolution.average_similarity(frame, chunk).collect()[0]
        assert got["comparisons"] == len(pairs) and abs(got["average_similarity"] * len(pairs) - want) < 1e-6
