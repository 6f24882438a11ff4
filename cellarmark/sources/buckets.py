"""Keyed tables in hash buckets, several of which change together in one commit.

A commit writes only the buckets that its keys fall in, each to a folder of its own number; a manifest then says, for every
bucket of every table, which commit wrote it last. The one-row head file of a commit is written after everything else, so a
reader sees all of a commit or nothing of it, and what a broken attempt left behind is overwritten by the next one of that number.

Layout below the root: ``data/<table>/commit=<n>/bucket=<b>``, ``manifest/commit=<n>``, ``head/commit=<n>``. One writer at a
time; any number of readers.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from cellarmark.sources.commits import commits, latest, record

MANIFEST = "table string, bucket int, commit_no long, schema string"


@dataclass(frozen=True)
class BucketStore:
    """Tables below ``root``; ``buckets`` is fixed when the store is made and must be the same in each use."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def bucket_of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def commits(self) -> DataFrame | None:
        """(commit, stream, batch_id) of every finished commit; None in a store without any."""
        return commits(self.spark, self.root)

    def latest(self) -> int | None:
        return latest(self.spark, self.root)

    def holds(self, stream: str, batch_id: int) -> bool:
        """Whether this batch of this stream, or a later one, has been committed."""
        known = self.commits()
        return known is not None and not known.filter((F.col("stream") == stream) & (F.col("batch_id") >= batch_id)).isEmpty()

    def manifest(self, commit: int | None) -> DataFrame:
        if commit is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/commit={commit}")

    def buckets_of(self, rows: DataFrame, key: str) -> list[int]:
        """Numbers of the buckets that the keys fall in: at most ``buckets`` of them."""
        return sorted(r[0] for r in rows.filter(F.col(key).isNotNull()).select(self.bucket_of(key)).distinct().collect())

    def read(self, table: str, only: list[int] | None = None, commit: int | None = None) -> DataFrame | None:
        """The table as of a commit (the latest by default), or these buckets of it; None if it was never written."""
        commit = self.latest() if commit is None else commit
        places = self.manifest(commit).filter(F.col("table") == table).collect()
        if not places:
            return None
        schema = StructType.fromJson(json.loads(places[0]["schema"]))
        wanted = [p for p in places if only is None or p["bucket"] in only]
        paths = [f"{self.root}/data/{table}/commit={p['commit_no']}/bucket={p['bucket']}" for p in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def appended(self, table: str, commit: int | None = None) -> DataFrame:
        """All rows of an append-only table up to a commit."""
        commit = self.latest() if commit is None else commit
        return self.spark.read.parquet(f"{self.root}/data/{table}").filter(F.col("commit") <= commit)

    def commit(
        self, keyed: dict[str, tuple[str, DataFrame]], appended: dict[str, DataFrame] | None = None, stream: str = "", batch_id: int = -1
    ) -> int:
        """Write whole new contents of the given rows' buckets, and append rows, as one commit; returns its number.

        ``keyed`` maps a table to (key, rows): a bucket that any row falls in is replaced by those rows, all others stay as they
        are. Rows without a key cannot be replaced later and are refused.
        """
        before = self.latest()
        number = 0 if before is None else before + 1
        changed = self.spark.createDataFrame([], MANIFEST)
        for table, (key, rows) in keyed.items():
            target = f"{self.root}/data/{table}/commit={number}"
            # rebalancing splits a large bucket over several files and joins small ones, by measured size
            placed = rows.withColumn("bucket", F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{table}: row without {key}"))).otherwise(self.bucket_of(key)))
            placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(target)
            with_bucket = StructType([*rows.schema.fields]).add("bucket", IntegerType())
            written = self.spark.read.schema(with_bucket).parquet(target).select("bucket").distinct()
            changed = changed.unionByName(
                written.select(F.lit(table).alias("table"), "bucket", F.lit(number).cast("long").alias("commit_no"), F.lit(rows.schema.json()).alias("schema"))
            )
        for table, rows in (appended or {}).items():
            rows.write.mode("overwrite").parquet(f"{self.root}/data/{table}/commit={number}")
        kept = self.manifest(before).join(changed.select("table", "bucket"), ["table", "bucket"], "left_anti")
        # the latest schema of a table holds for all its buckets; columns a bucket was written without read as null
        full = kept.unionByName(changed)
        newest = full.groupBy("table").agg(F.max_by("schema", "commit_no").alias("schema"))
        full.drop("schema").join(newest, "table").select("table", "bucket", "commit_no", "schema").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/manifest/commit={number}"
        )
        record(self.spark, self.root, number, stream, batch_id)
        return number
