"""Best-fit packing against the library's ids, exhaustive search and its own bounds."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellarmark.llm import best_fit
from cellarmark.llm.tokens import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, key int, bucket string, bin string, length int, sequence_id int, ids string, open int"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("aAéÉß'.,! \n\t　\xa0\x1c\x85日１s", max_size=40), st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", " the", "'ll", "\r\n", "x"]), max_size=12).map("".join), st.text("aéZ.,\n \0", max_size=20)), max_size=5))
def test_encoding_equals_the_library(texts):
    counts, ids = best_fit.encode_texts(PATH, pa.array(["left out", *texts], pa.string()).slice(1))
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts))][:-1] == [ids_of(t) for t in texts]


def fewest(lengths, capacity):
    """Exhaustive search over bins."""
    best = [len(lengths)]
    items = sorted(lengths, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for b in {r: b for b, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, [r - items[i] if k == b else r for k, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=9))))
def test_bounds_and_packings(case):
    capacity, lengths = case
    array = np.array(lengths, np.int64)
    bound = best_fit.lower_bound(np.bincount(array, minlength=capacity + 1), capacity)
    optimum = fewest(lengths, capacity)
    assert -(-sum(lengths) // capacity) <= bound <= optimum
    for packer in (best_fit.best_fit, best_fit.fullest):
        bins, offsets = packer(array, capacity)
        assert optimum <= bins.max() + 1 <= 1.5 * optimum + 1
        for b in range(bins.max() + 1):
            own = sorted(zip(offsets[bins == b].tolist(), array[bins == b].tolist()))
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
            assert 0 < sum(n for _, n in own) <= capacity


def test_bound_beats_the_mere_sum():
    assert best_fit.lower_bound(np.bincount([1100] * 10, minlength=2049), 2048) == 10
    assert best_fit.lower_bound(np.bincount([700] * 9, minlength=2049), 2048) == 5


def checked(rows, pieces, capacity):
    """Every id of every row in exactly one piece, pieces cut as stated, sequences gapless."""
    wanted = sorted(((i, tuple(ids_of(t) + [0])) for i, t in rows), key=str)
    cuts = sorted(str((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))) for i, ids in wanted for k, s, n in spans(len(ids), capacity))
    assert sorted(str((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"])) for p in pieces) == cuts
    used = {}
    for p in pieces:
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def spans(n, capacity):
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(k, s, first if first and k == 0 else capacity) for k, s in enumerate(starts)]


ODD = [(1, "alpha beta"), (1, "alpha beta"), (None, "x y z"), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, "wörd " * 3000), (6, "<|endoftext|> Émile's naïve “quoted” 日本 １２"), (7, "a" * 70_000), (8, "the " * 2047 + "the")]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "b", "c", 2, 3, "d", 4) for i, t in ODD], SCHEMA).repartition(3)
    checked(ODD, best_fit.pack(docs, PATH).collect(), 2048)
    assert best_fit.pack(docs.limit(0), PATH).collect() == []


def test_exchange_over_many_partitions(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(["word"] * rnd.choice([3, 9, 20, 27, 31, 40]))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    alone = best_fit.pack(docs, PATH, capacity=64, group=1_000_000)
    parts = best_fit.pack(docs, PATH, capacity=64, group=100)
    checked(rows, parts.collect(), 64)
    bins, bound = best_fit.certificate(parts, 64)
    assert bound <= best_fit.certificate(alone, 64)[0] <= bins <= bound + 5


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    pieces = best_fit.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH)
    used = checked(rows, pieces.collect(), 2048)
    assert (used, used - 1) == best_fit.certificate(pieces) or used == best_fit.certificate(pieces)[1]
    assert best_fit.op13_best_fit_packing(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("n, lengths", [(0, []), (1, [1]), (2048, [2048]), (2049, [1, 2048]), (5000, [904, 2048, 2048])])
def test_cut(n, lengths):
    assert best_fit.cut(n, 2048) == lengths
