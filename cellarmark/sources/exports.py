"""Exports of several CSV tables that appear together or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellarmark.sources.commits import latest, record

MANIFEST = "table string, row_count long, columns array<string>"


def export_all(spark: SparkSession, tables: dict[str, DataFrame], root: str, name: str = "export") -> int:
    """Write the tables as CSV below a new number and declare them finished last; returns the number.

    Until then readers see the export before. Rows are counted while they are written, so no table is computed twice. A number
    whose attempt broke off is written anew by the next export. Values within a table must be plain columns, as CSV has no others.
    """
    before = latest(spark, root)
    number = 0 if before is None else before + 1
    manifest = []
    for table, df in tables.items():
        seen = Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{root}/export={number}/{table}")
        manifest.append((table, seen.get["n"], df.columns))
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/commit={number}")
    record(spark, root, number, name)
    return number


def export_manifest(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """Tables of a finished export (the latest by default) with their rows and columns; empty where there is none."""
    number = latest(spark, root) if number is None else number
    return spark.createDataFrame([], MANIFEST) if number is None else spark.read.schema(MANIFEST).parquet(f"{root}/manifest/commit={number}")


def read_export(spark: SparkSession, root: str, table: str, number: int | None = None) -> DataFrame:
    """A table of a finished export as text columns; an error where it is not in it."""
    number = latest(spark, root) if number is None else number
    known = export_manifest(spark, root, number).filter(F.col("table") == table).first()
    if known is None:
        raise FileNotFoundError(f"no table {table} in the export below {root}")
    schema = ", ".join(f"`{c}` string" for c in known["columns"])
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{root}/export={number}/{table}")
