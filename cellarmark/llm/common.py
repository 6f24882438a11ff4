"""Table access and stored intermediates of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.session import scan_bytes, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write once, read back: later branches neither recompute ``df`` nor depend on executors that may be lost.

    The write's shuffle files go with it instead of staying until the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave, once all that is made of them is stored."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def sent(spark: SparkSession, value: Any) -> Iterator[Broadcast]:
    """``value`` at every worker for as long as the block lasts; what is made of it must be stored by then."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Both sides shuffled and merged at every size, where both grow with the corpus.

    On small tables Spark would choose a broadcast for each such join, and the driver would hold dozens of hash tables of several MB.
    """
    return left.join(right.hint("merge"), on, how)


ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique number of each row in ``ROW``, the same whenever the frame is read again.

    Rows of a Parquet table are numbered by file and place there; other frames are stored with their numbers.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() == "Project":  # chosen columns of a table: its rows
        plan = plan.child()
    fields = docs.select("_metadata").schema["_metadata"].dataType.fieldNames() if plan.getClass().getSimpleName() == "LogicalRelation" else []
    if "row_index" not in fields:
        return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered-rows")
    file, place, number = (free_name(n, docs.columns) for n in ("_file", "_place", "_number"))
    placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    files = sorted(r[file] for r in placed.select(file).distinct().collect())  # one name per file
    # as an Arrow table: a list would start Python processes of its own on the executors
    names = docs.sparkSession.createDataFrame(pa.table({number: pa.array(range(len(files)), pa.int64()), file: pa.array(files, pa.string())}))
    return placed.join(F.broadcast(names), file).withColumn(ROW, F.shiftleft(number, 40) + F.col(place)).drop(file, place, number)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def shards_for(df: DataFrame, shard_bytes: int, most: int = 20_000) -> int:
    """Partitions of about ``shard_bytes`` of the scan behind ``df``, two for each core at least."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(most, max(2 * cores, -(-scan_bytes(df) // shard_bytes))))


def bounded(texts: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """``texts``, after asking the session to hand rows to Python workers in batches of about ``most_bytes``."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
    return texts


def byte_slices(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most_bytes`` of text each."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most_bytes
    bounds = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(size)]
    yield from zip(bounds[:-1], bounds[1:], strict=True)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of a sorted partition: rows in a row with equal ``key`` (a number), one table per group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()]
        if held and values[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            held.append(batch.slice(a, b - a))
            if b < len(values):
                yield pa.Table.from_batches(held)
                held = []
        last = values[-1]
    if held:
        yield pa.Table.from_batches(held)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
