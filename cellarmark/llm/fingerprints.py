"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by its own content: runs of one symbol become one symbol, deterministic coin tossing
reduces the symbols to six labels that depend on four neighbours to the left, and a phrase starts at each local
maximum of the labels. A phrase's name is a hash of its symbols; the names form the next level's text. Equal
substrings so have equal phrases except near their ends, wherever they stand.

The fingerprint holds the smallest hashes of the phrase names of the levels in ``LEVELS``, each occurrence numbered, as
hex numbers. Likeness of two fingerprints estimates the share of common phrases in the mean number of phrases.

Defined cases: null counts as empty, whose fingerprint is empty and like another empty one only; repeated ids are
ordered by text hash and text; null ids come last; a single document is its own successor; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarmark.llm.common import bounded, shards_for, table, text_or_empty
from cellarmark.llm.shingles import FACTOR, mixed

LEVELS = (2, 3)
SHORT = 64
"""Texts of fewer characters are described by their first-level phrases too."""
KEPT = 64
"""Hashes in a fingerprint."""
SYMBOLS_AT_ONCE = 1_000_000


def tossed(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest bit that differs from the left neighbour's label, plus that bit."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[first] = ~labels[first]  # nothing to the left: as if every bit differed
    differ = labels ^ before
    place = np.bitwise_count((differ & (~differ + labels.dtype.type(1))) - labels.dtype.type(1))
    return (2 * place + ((labels >> place.astype(labels.dtype)) & labels.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def phrases(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next level of several non-empty texts laid end to end: phrase names and where each text starts."""
    is_start = np.zeros(len(names), bool)
    is_start[starts] = True
    new_run = is_start.copy()
    new_run[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new_run)
    length = np.diff(at, append=len(names)).astype(np.uint64)
    symbols, first = names[at], np.flatnonzero(is_start[at])
    long_run = length > 1
    if long_run.any():
        symbols = symbols.copy()
        symbols[long_run] = mixed(symbols[long_run] + length[long_run] * FACTOR)
    labels = symbols
    for _ in range(4):  # 64 bits, then at most 128, 14, 8 and 6 labels
        labels = tossed(labels, first)
    after = np.append(labels[1:], np.uint8(255))
    after[first[1:] - 1] = 255
    cut = labels > after
    cut[1:] &= labels[1:] > labels[:-1]
    cut[first] = True
    begin = np.flatnonzero(cut)
    inside = np.arange(len(symbols)) - np.repeat(begin, np.diff(begin, append=len(symbols)))
    powers = np.cumprod(np.full(int(inside.max()) + 1, FACTOR, np.uint64))
    named = mixed(np.add.reduceat(symbols * powers[inside], begin))
    return named, np.searchsorted(begin, first)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The smallest distinct phrase hashes (32 bits, sorted) of each text."""
    result: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    part = np.cumsum(lengths) // SYMBOLS_AT_ONCE
    for p in np.unique(part):
        rows = np.flatnonzero((part == p) & (lengths > 0))
        if len(rows):
            names = np.frombuffer("".join([texts[r] for r in rows]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            starts = np.cumsum(lengths[rows]) - lengths[rows]
            for r, s in zip(rows, sketches_of(names, starts), strict=True):
                result[r] = s
    return result


def sketches_of(names: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    short = np.diff(starts, append=len(names)) < SHORT
    levels = []
    for level in range(1, max(LEVELS) + 1):
        names, starts = phrases(names, starts)
        hashes, ends = mixed(names + np.uint64(level)), np.append(starts[1:], len(names))
        levels.append((hashes, starts, ends, level in LEVELS))
    return [smallest(np.concatenate([h[b[i] : e[i]] for h, b, e, listed in levels if listed or short[i]])) for i in range(len(short))]


def smallest(hashes: np.ndarray) -> np.ndarray:
    """Sketch of a text's phrases, where each occurrence of a phrase counts."""
    distinct, counts = np.unique(hashes, return_counts=True)
    occurrence = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    numbered = mixed(np.repeat(distinct, counts) + occurrence.astype(np.uint64) * FACTOR)
    return np.unique(numbered >> np.uint64(32))[:KEPT].astype(np.uint32)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common phrases in the mean number of phrases, estimated from the smallest hashes of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    size = len(a) + len(b) - len(both)
    if size > KEPT and (len(a) == KEPT or len(b) == KEPT):
        limit = np.sort(np.concatenate([a, np.setdiff1d(b, a, assume_unique=True)]))[KEPT - 1]
        both, size = both[both <= limit], KEPT
    shared = len(both) / size
    return 2 * shared / (1 + shared)


def with_successors(docs: DataFrame, shard_bytes: int = 16 << 20) -> DataFrame:
    """(bucket, tail, doc_id, text) such that a bucket's rows in order (doc_id descending, ``tail`` last) follow one another.

    Ids are cut into ranges of equal width. The first document of a range is also sent, as tail, to the range before;
    only one id per range (at most ``shards_for`` ranges) is gathered for that.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = float(ends["low"] or 0), float(ends["high"] or 0)
    ranges = 4 * shards_for(docs, shard_bytes)
    place = F.floor((F.lit(high) - F.col("doc_id").cast("double")) / max(1.0, (high - low) / ranges))
    rows = rows.withColumn("bucket", F.coalesce(place, F.lit(ranges + 2)).cast("long"))
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    line = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(line), F.max("bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("head", before.alias("bucket"))
    tails = rows.drop("bucket").join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
    return rows.select("bucket", F.lit(0).alias("tail"), "doc_id", "text").union(tails.select("bucket", F.lit(1).alias("tail"), "doc_id", "text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of whole texts (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chained(batches):
            yield compared(*chunk)

    ordered = with_successors(bounded(docs)).repartition("bucket").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions("bucket", "tail", F.desc("doc_id"), "tie", "text").select("bucket", "tail", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(work, schema)


def chained(batches: Iterator[pa.RecordBatch], most_rows: int = 1000) -> Iterator[tuple[list, list[str]]]:
    """Slices of ids and texts; the last text only follows the one before it."""
    held: tuple | None = None
    for batch in (b.slice(at, most_rows) for b in batches for at in range(0, b.num_rows, most_rows)):
        bucket, tail = batch.column("bucket").to_numpy(), batch.column("tail").to_numpy()
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        at = 0
        while at < len(ids):
            stop = at + int(np.searchsorted(bucket[at:], bucket[at], "right"))
            closing = np.flatnonzero(tail[at:stop])
            end = at + int(closing[0]) + 1 if len(closing) else stop
            run_ids, run_texts = ids[at:end], texts[at:end]
            if held is not None and held[0] == bucket[at]:
                run_ids, run_texts = [held[1], *run_ids], [held[2], *run_texts]
            if len(run_ids) > 1:
                yield run_ids[:-1], run_texts
            # A tail row closes its bucket; further ones repeat the same id.
            held = None if len(closing) else (bucket[at], run_ids[-1], run_texts[-1])
            at = stop


def compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    edited = []
    for text, following in zip(texts, texts[1:], strict=False):
        k = len(text) // 3
        edited.append(text[: len(text) - k] + following[:k])
    own, changed = sketches(texts), sketches(edited)
    rows = range(len(ids))
    return pa.record_batch(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(texts[i]) for i in rows], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            "fingerprint": pa.array([written(own[i]) for i in rows]),
            "edited_fingerprint": pa.array([written(changed[i]) for i in rows]),
            "near_edited": pa.array([likeness(own[i], changed[i]) for i in rows], pa.float64()),
            "near_next": pa.array([likeness(own[i], own[i + 1]) for i in rows], pa.float64()),
        }
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
