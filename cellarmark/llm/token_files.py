"""Token-id files: ORC stripes of integer-run-length-encoded ids with row indexes and Bloom filters.

Documents are range-partitioned and sorted by id, encoded, and written one file a partition. ORC keeps
the ids as run-length encoded integers, an index entry per ``row_index_stride`` rows and a Bloom filter on
``doc_id``, so stripes are read in parallel and a lookup by id skips those that cannot hold it.

Defined cases: null text counts as empty and yields the end id only; repeated doc ids are kept, ordered by
text; null doc ids come first; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarmark.llm.common import bounded, fresh_path, shards_for, table
from cellarmark.llm.tokens import encode_batches, vocabulary

END_ID = 1
FILE_SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, shard_bytes: int = 64 << 20, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files in ascending doc_id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for batch, sizes, ids in encode_batches(vocabulary_path, batches, end_id):
            ends = np.cumsum(sizes)
            yield pa.record_batch(
                {
                    "shard": pa.array(np.full(len(sizes), shard, np.int32)),
                    "doc_id": batch.column("doc_id"),
                    "shard_start": pa.array(at + ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))),
                }
            )
            at += int(ends[-1]) if len(ends) else 0

    order = ["doc_id", "tie", "text"]
    keyed = bounded(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(shards_for(docs, shard_bytes), *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    (
        ordered.mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; stripes are read in parallel.

    The offsets of the files come from one short row per file, at most as many as ``shards_for`` allows.
    """
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.groupBy("shard").agg(F.sum("n_tokens").alias("size")).select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    placed = files.join(F.broadcast(offsets), "shard")
    return placed.select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """Rows of one document; the filter reaches the scan, whose Bloom filters and indexes skip other stripes."""
    return spark.read.schema(FILE_SCHEMA).orc(path).filter(F.col("doc_id") == doc_id).select("doc_id", "n_tokens", "ids")


def checked_sums(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            at = np.asarray(lists.offsets)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": pa.array(np.diff(at).astype(np.int64)), "ids_crc32": pa.array(sums, pa.int64())})

    return documents.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary())
    return checked_sums(read_token_files(spark, path))
