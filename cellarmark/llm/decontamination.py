"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed by exact shingle containment.

Test items are partitioned by size; an item's sketch holds its smallest shingle hashes, as many as its partition's
largest size calls for: ``floor((1 - containment) * size) + 1``. A document that contains the item to the given degree
lacks at most one shingle less than that, so it shares at least one sketch value: the search misses nothing, whatever
the document's length. A Bloom filter of fixed size over the items' shingles goes to every worker and lets a document
scan keep the few hashes that may matter; the rest is equi-joins on those.

Defined cases: null or empty texts and items match nothing; an item of fewer words than a shingle matches only a
document with the same whole word sequence; repeated items are reported each, repeated documents once; an empty
benchmark or document table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.llm.bloom import holds, words_of
from cellarmark.llm.common import ROW, bounded, sent, stored, table
from cellarmark.llm.shingles import shingle_sets

WIDTH = 5
PERCENT = 80


def item_sets(items: DataFrame, width: int) -> DataFrame:
    """item_id, n, shingles (smallest first) of items with words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64).tolist() for s in shingle_sets(batch.column("text"), width)]
            yield pa.record_batch({"item_id": batch.column("item_id"), "n": pa.array(map(len, sets), pa.int64()), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(compute, "item_id long, n long, shingles array<long>").filter("n > 0")


def documents_with_hits(docs: DataFrame, filter_words: Broadcast, width: int) -> DataFrame:
    """doc_id and the shingle hashes that pass the filter, for documents that have some; row numbers if ``docs`` has them."""
    carried = [ROW] if ROW in docs.columns else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filter_words.value
        for batch in batches:
            rows, hits = [], []
            for row, s in enumerate(shingle_sets(batch.column("text"), width)):
                if len(s):
                    passed = s[holds(words, s)]
                    if len(passed):
                        rows.append(row)
                        hits.append(passed.view(np.int64).tolist())
            yield pa.record_batch({c: batch.column(c).take(pa.array(rows, pa.int64())) for c in [*carried, "doc_id"]} | {"hits": pa.array(hits, pa.list_(pa.int64()))})

    schema = ", ".join([*(f"{c} long" for c in carried), "doc_id long, hits array<long>"])
    return bounded(docs).select(*carried, F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_item, n_common for all pairs with 100 * common >= percent * item size; row numbers too if ``docs`` has them."""
    carried = [ROW] if ROW in docs.columns else []
    size_class = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")
    sets = stored(item_sets(items, width).withColumn("item", F.monotonically_increasing_id()), "benchmark-sets")
    # Signed order of the hashes; any order that all sets share will do.
    sketch_size = (F.floor(F.col("size_class") * (100 - percent) / 100) + 1).cast("int")
    sketch = F.slice(F.array_sort("shingles"), F.lit(1), sketch_size)
    sketches = sets.withColumn("size_class", size_class).select("item", F.explode(sketch).alias("hash"))
    with sent(docs.sparkSession, words_of(sets.select(F.explode("shingles").alias("hash")))) as filter_words:
        hits = stored(documents_with_hits(docs, filter_words, width).withColumn("row", F.monotonically_increasing_id()), "benchmark-hits")
    candidates = hits.select("row", F.explode("hits").alias("hash")).join(sketches, "hash").select("row", "item").distinct()
    common = F.size(F.array_intersect("hits", "shingles")).cast("long")
    verified = candidates.join(hits, "row").join(sets, "item").withColumn("n_common", common).filter(100 * F.col("n_common") >= percent * F.col("n"))
    return verified.select(*carried, "doc_id", "item_id", F.col("n").alias("n_item"), "n_common").distinct()


def op6_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contained_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return pairs.select("doc_id", "item_id", "n_item", "n_common")
