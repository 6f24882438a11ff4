"""Session settings and the lineage cut shared by the iterative operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT = 64 * 1024 * 1024

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, app: str = "cellarmark") -> SparkSession:
    """Single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("CELLARMARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a temporary folder serves a local session; any other session must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _LOCAL_FOLDERS[application]
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's state in the reliable checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scan_bytes(df: DataFrame) -> int:
    """Bytes Spark expects this frame to hold: the file sizes, for a plain table scan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, source: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast ``df`` when the table it is a row-by-row view of measures at most ``limit`` bytes.

    Join estimates multiply table sizes, so a lookup of two tiny tables looks large to the planner;
    its source scan does not. Beyond the limit the join is left to Spark.
    """
    return F.broadcast(df) if scan_bytes(source) <= limit else df


def spread_if_narrow(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan over the cores when its files split into fewer tasks than there are cores.

    Meant for small or unsplittable inputs under heavy expressions; a scan that already fills the
    cluster is returned unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, key) if splits < cores else df
