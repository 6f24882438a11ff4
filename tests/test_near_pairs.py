"""The array forms of the sequence ratio and of the candidate comparison against plain Python over all pairs."""

import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cellarmark.functions import candidates, similarity


def texts(seed, n, alphabet, longest):
    rng = random.Random(seed)
    return ["", *("".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n))]


def test_ratios_in_arrays_equal_the_sequence_matcher():
    for seed, alphabet in enumerate(["ab", "abc ", "RED BLUE OAK 1234567890", "aé\U0001f377ß"]):
        a, b = texts(seed, 400, alphabet, 120), texts(seed + 9, 400, alphabet, 230)
        pairs = [*zip(a, b), *zip(a, a), *zip([x[:20] for x in a], [y[:25] for y in b])]
        got = similarity.sequence_ratios([x for x, _ in pairs], [y for _, y in pairs])
        assert got.tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    assert similarity.sequence_ratios([], []).tolist() == []


def test_longest_block_equals_the_sequence_matcher(spark):
    def block(x, y):
        hit = SequenceMatcher(None, x.lower(), y.lower()).find_longest_match(0, len(x), 0, len(y))
        return x[hit.a : hit.a + hit.size] if hit.size > 3 else ""

    for longest in (20, 130):
        pairs = list(zip(texts(3, 200, "aBc", longest), texts(4, 200, "AbC", longest)))
        df = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, a string, b string")
        got = df.select("n", similarity.longest_common_substring(F.col("a"), F.col("b")).alias("c")).orderBy("n").collect()
        assert [r["c"] for r in got] == [block(x, y) for x, y in pairs]


def test_near_pairs_are_those_of_all_pairs(spark):
    a, b = sorted(set(texts(5, 300, "abcd ", 12))), sorted(set(texts(6, 400, "abcd ", 12)))
    frame = lambda side, name, least: spark.createDataFrame([(t, t, least) for t in side], f"{name} string, text string, least double")
    for contained in (False, True):
        got = [tuple(r) for r in candidates.near_pairs(frame(a, "x", 0.6), frame(b, "y", 0.7), contained).collect()]
        want = set()
        for x in a:
            for y in b:
                common = (Counter(x) & Counter(y)).total()
                if 2 * common >= 0.7 * (len(x) + len(y)) - 1e-9 or (contained and common == min(len(x), len(y))):
                    want.add((x, y))
        assert len(got) == len(set(got)) and set(got) == want
        assert {(x, y) for x in a for y in b if SequenceMatcher(None, x, y).ratio() >= 0.7} <= set(got)
    assert candidates.near_pairs(frame([], "x", 0.6), frame(b, "y", 0.7)).count() == 0
