"""Numbered commits below a folder: whatever a commit wrote counts once its one-row head file is there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def commits(spark: SparkSession, root: str) -> DataFrame | None:
    """(stream, batch_id, committed, commit) of every finished commit; None where there is none."""
    try:
        return spark.read.parquet(f"{root}/head").withColumn("commit", F.col("commit").cast("long"))
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def latest(spark: SparkSession, root: str) -> int | None:
    known = commits(spark, root)
    return None if known is None else known.agg(F.max("commit")).first()[0]


def record(spark: SparkSession, root: str, number: int, stream: str = "", batch_id: int = -1) -> None:
    """Declare a commit finished; to be called when all it wrote is in place."""
    head = spark.range(1).select(F.lit(stream).alias("stream"), F.lit(batch_id).cast("long").alias("batch_id"), F.current_timestamp().alias("committed"))
    head.coalesce(1).write.mode("overwrite").parquet(f"{root}/head/commit={number}")
