"""Versioned snapshots with a manifest, JSON documents, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "timestamp string, event_type string, brand_name string, domain string, confidence_predicted double, user_action string,"
    " features map<string,string>, metadata map<string,string>"
)
MERGE_FEEDBACK_SCHEMA = (
    "timestamp string, brand_group array<string>, canonical_brand string, user_action string, confidence_predicted double, reason string"
)


def version_of_file(path: Column) -> Column:
    """Snapshot version: the leading digits of a file name such as 20250808_164444.csv."""
    return F.regexp_extract(path, r"(\d+)_[^/]*$", 1)


def write_snapshot(df: DataFrame, root: str, version: str, filename: str) -> None:
    """Write one version as a partition folder, then append its manifest row.

    The manifest row is written last, so a reader never sees a version whose files are incomplete.
    """
    target = f"{root}/data/version={version}"
    df.write.mode("overwrite").parquet(target)
    stored = df.sparkSession.read.parquet(target)
    row = stored.agg(F.count("*").alias("row_count")).select(
        F.lit(version).alias("version"), F.lit(filename).alias("filename"), F.current_timestamp().alias("uploaded"), "row_count",
        F.lit(len(df.columns)).alias("column_count"),
    )
    row.write.mode("append").parquet(f"{root}/manifest")


def current_version(spark: SparkSession, root: str) -> str:
    return spark.read.parquet(f"{root}/manifest").agg(F.max_by("version", F.struct("uploaded", "version"))).first()[0]


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """One version (the current one by default); other versions' folders are never listed."""
    return spark.read.parquet(f"{root}/data/version={version or current_version(spark, root)}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(path, multiLine=True)


def read_merge_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MERGE_FEEDBACK_SCHEMA).json(path, multiLine=True)


def read_keyed_document(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object of key -> record as (key, record columns) rows."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"map<string,struct<{value_schema}>>")
    return text.select(F.explode(parsed)).select("key", "value.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_backup(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def append_history(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def recent_uploads(history: DataFrame, k: int = 10) -> DataFrame:
    return history.orderBy(F.desc("upload_date"), "filename").limit(k)


def export_matched(matched: DataFrame, path: str) -> DataFrame:
    """Write matched rows as CSV; returns the ten-row preview."""
    write_csv(matched, path)
    return matched.limit(10)


def export_views(brands: DataFrame, skus: DataFrame, importer_bridge: DataFrame, importers: DataFrame) -> dict[str, DataFrame]:
    """The named export tables: brands with and without importers, with labels, importers, active ones."""
    imported = importer_bridge.select("brand_name").distinct()
    names = brands.select("brand_name")
    active = importer_bridge.select(F.col("permit_no").alias("permit_number")).distinct()
    ranked = importer_bridge.groupBy(F.col("permit_no").alias("permit_number")).agg(F.count("*").alias("brand_count"))
    return {
        "brands_with_importers": names.join(imported, "brand_name", "left_semi"),
        "brands_without_importers": names.join(imported, "brand_name", "left_anti"),
        "brands_with_skus": skus.groupBy("brand_name").agg(F.count("*").alias("sku_count")),
        "unmatched": skus.join(active, skus["permit_no"] == active["permit_number"], "left_anti"),
        "importers": importers,
        "active_importers": importers.join(active, "permit_number", "left_semi"),
        "importer_rankings": ranked,
    }
