"""Harmonic packing of token ids into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (capacity / (k + 1), capacity / k]
and each of its bins takes exactly k pieces, so a worker fills its bins without looking at others. A document
is cut where its class would waste more than ``slack``: whole capacities first, then the largest length
capacity // k that fits. Bins still open at a worker's end are joined in groups of workers by cutting their
pieces to fill sequences exactly; only the last sequence of a group is padded.

Defined cases: null text counts as empty (the end id alone); repeated rows are packed as often as they occur;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.llm.common import bounded, stored, table
from cellarmark.llm.tokens import encode_batches, vocabulary

CAPACITY = 2048
END_ID = 1
WORKERS_JOINED = 64
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, worker int"


def cut_lengths(n: int, capacity: int, slack: int) -> list[int]:
    """Piece lengths of a document of n ids, in order."""
    whole, rest = divmod(n, capacity)
    lengths = [capacity] * whole
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack:
            return [*lengths, rest]
        # The largest length that fills a bin with k + 1 equal pieces.
        lengths.append(capacity // (k + 1))
        rest -= lengths[-1]
    return lengths


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, capacity: int = CAPACITY, slack: float = 1 / 32) -> DataFrame:
    """Pieces of all documents with their sequence, the place in it and their ids (little-endian 32-bit).

    The encoded pieces are stored once in the shared folder; a worker holds its open bins, at most one per
    class, and a group of workers is joined from what was left open.
    """
    allowed = int(capacity * slack)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, filled = TaskContext.get().partitionId(), 0
        cuts: dict[int, list[int]] = {}
        bins: dict[int, list[tuple]] = {}
        for batch, sizes, ids in encode_batches(vocabulary_path, batches, end_id):
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            rows: list[tuple] = []
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                start = 0
                if n not in cuts:
                    cuts[n] = cut_lengths(n, capacity, allowed)
                for length in cuts[n]:
                    k = capacity // length
                    held = bins.setdefault(k, [])
                    held.append((doc_id, start, length, n, bytes(data[4 * (at + start) : 4 * (at + start + length)])))
                    start += length
                    if len(held) == k:
                        rows += numbered(held, (worker << 40) + filled, worker)
                        filled += 1
                        bins[k] = []
                at += n
            yield as_batch(rows)
        yield as_batch([(*p[:4], None, None, p[4], worker) for held in bins.values() for p in held])

    def join_open(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        group, rows, at = int(key[0]), [], 0
        for p in pieces.sort_values(["worker", "length", "doc_id", "start"], ascending=[True, False, True, True]).itertuples(index=False):
            start, left, ids = int(p.start), int(p.length), p.ids
            while left:
                take = min(left, capacity - at % capacity)
                rows.append((p.doc_id, start, take, p.doc_tokens, (1 << 62) + (group << 40) + at // capacity, at % capacity, ids[: 4 * take], p.worker))
                start, left, ids, at = start + take, left - take, ids[4 * take :], at + take
        return pd.DataFrame(rows, columns=pieces.columns)

    encoded = bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(fill, PIECES)
    pieces = stored(encoded, "packed-pieces", "zstd")
    full = pieces.filter(F.col("sequence_id").isNotNull())
    opened = pieces.filter(F.col("sequence_id").isNull())
    joined = opened.groupBy(F.floor(F.col("worker") / WORKERS_JOINED)).applyInPandas(join_open, PIECES)
    return full.unionByName(joined).drop("worker")


def numbered(held: list[tuple], sequence_id: int, worker: int) -> list[tuple]:
    rows, offset = [], 0
    for p in held:
        rows.append((*p[:4], sequence_id, offset, p[4], worker))
        offset += p[2]
    return rows


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.int32()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length and the ids of each sequence, unpadded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), ""))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), ordered.alias("parts")).select("sequence_id", "length", joined.alias("ids"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
