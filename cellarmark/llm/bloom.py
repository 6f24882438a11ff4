"""A Bloom filter of fixed size that lets a scan pass over rows which cannot join.

``BLOOM_BITS`` bits go to every worker whatever the number of keys: with more keys it only gets less selective, so
an exact join always follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOOM_BITS = 1 << 23
BLOOM_HASHES = 3


def positions(hashes: np.ndarray) -> np.ndarray:
    """Bits of each 64-bit hash in the filter."""
    return np.stack([(hashes >> np.uint64(20 * j)) % np.uint64(BLOOM_BITS) for j in range(BLOOM_HASHES)])


def holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = positions(hashes)
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def hash_column(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)


def words_of(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray] = hash_column) -> np.ndarray:
    """The filter over ``hashes`` of all rows (their column ``hash``) as 64-bit words: at most ``BLOOM_BITS / 64`` short rows reach the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(positions(hashes(batch))).astype(np.int64)
            yield pa.record_batch({"word": pa.array(at >> 6), "mask": pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))})

    words = np.zeros(BLOOM_BITS // 64, np.uint64)
    merged = rows.mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words[merged.column("word").to_numpy()] = merged.column("mask").to_numpy().view(np.uint64)
    return words


def bloom_words(keys: DataFrame, column: str) -> np.ndarray:
    return words_of(keys.select(F.xxhash64(column).alias("hash")))


def may_hold(rows: DataFrame, column: str, shared: Broadcast) -> DataFrame:
    """The rows whose key may be among the keys of the filter that is sent to the workers."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(shared.value, batch.column("_hash").to_numpy(zero_copy_only=False).view(np.uint64)))).drop_columns(["_hash"])

    return rows.withColumn("_hash", F.xxhash64(column)).mapInArrow(keep, rows.schema)
