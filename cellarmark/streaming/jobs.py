"""Structured Streaming forms of ingestion, feedback statistics and request monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellarmark.operators.learning import confidence_boost, touched_patterns
from cellarmark.operators.upserts import upload_counters, upsert, upsert_brands
from cellarmark.sources.buckets import BucketStore


BRAND_SETS = {"permit_numbers": "permit_no", "countries": "origin_desc", "class_types": "class_type_desc"}


def apply_labels(store: BucketStore, rows: DataFrame, name: str, batch_id: int, masters: DataFrame | None = None) -> int | None:
    """One upload into the tables labels, brands and uploads, as one commit; its number, or None where nothing was to do.

    ``rows`` carry ttb_id, brand_name and file_order, and as many of the brand sets' columns as the file has. Only the buckets
    that the upload's labels and brands fall in are read and written. A batch of ``name`` that was committed before is left out;
    so is an empty one. Labels without a ttb_id cannot be keyed: they count as rejected; labels without a brand grow no brand.
    """
    if store.holds(name, batch_id) or rows.isEmpty():
        return None
    spark = store.spark
    keyed = rows.filter(F.col("ttb_id").isNotNull())
    absent = {c: F.lit(None).cast("string") for c in BRAND_SETS.values() if c not in keyed.columns}
    named = keyed.filter(F.col("brand_name").isNotNull()).withColumns(absent)
    old_labels = store.read("labels", store.buckets_of(keyed, "ttb_id"))
    if old_labels is None:
        old_labels = spark.createDataFrame([], keyed.drop("file_order").schema)
    for column in [c for c in keyed.columns if c not in [*old_labels.columns, "file_order"]]:
        old_labels = old_labels.withColumn(column, F.lit(None).cast(keyed.schema[column].dataType))
    old_brands = store.read("brands", store.buckets_of(named, "brand_name"))
    if old_brands is None:
        old_brands = spark.createDataFrame([], "brand_name string, " + ", ".join(f"{target} array<string>" for target in BRAND_SETS))
    labels = upsert(old_labels, keyed, "ttb_id", "file_order").drop("change_type")
    brands = upsert_brands(old_brands, named, BRAND_SETS).drop("change_type")
    if masters is None:
        masters = spark.createDataFrame([], "kind string, permit_number string")
    counts = upload_counters(keyed.withColumns(absent), old_labels, old_brands, masters).crossJoin(rows.agg(F.count_if(F.col("ttb_id").isNull()).alias("rejected")))
    history = counts.withColumns({"upload": F.lit(name), "batch_id": F.lit(batch_id).cast("long"), "upload_date": F.current_timestamp()})
    return store.commit({"labels": ("ttb_id", labels), "brands": ("brand_name", brands)}, {"uploads": history}, name, batch_id)


def ingest_labels(
    uploads: DataFrame, root: str, checkpoint: str, buckets: int = 64, name: str = "labels", masters: DataFrame | None = None
) -> StreamingQuery:
    """Apply arriving label files to the bucketed tables below ``root``, one commit per micro-batch.

    The store may hold tables already (of an earlier import or another stream); the first batch goes on top of them. A batch
    replayed after a failure is recognised by the stream's name and its number, so a name must not be used with a new checkpoint.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        # a file may be read in several tasks in any order; within one block the row ids rise
        order = F.struct(F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("block"), F.monotonically_increasing_id().alias("row"))
        rows = batch.withColumn("file_order", F.col("file_order") if "file_order" in batch.columns else order).persist()
        try:
            apply_labels(BucketStore(batch.sparkSession, root, buckets), rows, name, batch_id, masters)
        finally:
            rows.unpersist()

    return uploads.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def latest_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels as of the latest commit; an error where none was made."""
    labels = BucketStore(spark, root).read("labels")
    if labels is None:
        raise FileNotFoundError(f"no labels below {root}")
    return labels


def stream_patterns(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Continuous pattern statistics; an event delivered twice within the delay counts once."""
    unique = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    stats = touched_patterns(unique).groupBy("pattern_type", "pattern").agg(
        F.sum("success").alias("successes"), F.count("*").alias("sample_count"), F.max("ts").alias("last_updated")
    )
    rate = F.col("successes") / F.col("sample_count")
    return stats.withColumns({"success_rate": rate, "confidence_boost": confidence_boost(rate, F.col("sample_count"))})


def stream_request_counts(log: DataFrame, delay: str = "10 minutes", length: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Requests per service in sliding windows, with their failures."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", length, slide), "service")
        .agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failures"), F.avg("latency").alias("avg_latency"))
    )


def stream_retained(log: DataFrame, hours: int = 24) -> DataFrame:
    """Records younger than the limit at the time they are read."""
    return log.filter(F.col("ts") >= F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(hours)))


def run_to_memory(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Drain a bounded stream into a memory table; for tests and small replays only."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.table(name)
