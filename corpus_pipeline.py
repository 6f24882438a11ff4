"""Corpus pipeline: named stages over the documents table, each written as Parquet and read again.

Every stage but the last returns the columns it was given. A stage numbers the rows of its input and decides row by row,
whatever their ids; of each near-duplicate class one row is kept (the smallest id; without any id the first row), and of
rows without words one for each id and text. Null and
empty texts are kept by the filters and packed as an end id alone; empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.llm import decontamination, minmax, packing, quality
from cellarmark.llm.common import ROW, numbered, stored, table
from cellarmark.llm.tokens import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    rows = numbered(docs)
    judged = quality.classify(rows, table(spark, sf_dir, "labels"))
    return rows.join(judged.filter("not kept").select(ROW), ROW, "left_anti").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: five-word shingles, similarity 0.8 or more."""
    rows = numbered(docs)
    near = stored(minmax.near_duplicates(rows, width=5, percent=80, bands=48, rows=5).select(ROW, "doc_id", "class"), "near-rows")
    first = F.min_by(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias(ROW)
    linked = near.filter("class is not null").groupBy("class").agg(first).select(ROW)
    wordless = rows.join(near.filter("class is null").select(ROW), ROW, "left_semi")
    kept = linked.unionByName(wordless.groupBy("doc_id", "text").agg(F.min(ROW).alias(ROW)).select(ROW))
    return rows.join(kept, ROW, "left_semi").select(docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    rows = numbered(docs)
    found = decontamination.contained_items(rows, table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(ROW).distinct(), ROW, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece with its sequence, its place there and its ids."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near-dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None
"""Language models, signatures and token ids have no SQL form; the tests compare the stages with brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
