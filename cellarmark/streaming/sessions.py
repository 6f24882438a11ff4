"""Success rate, mean latency and failure streak of request services as keyed streaming state.

State is held per cell, a (service, time slice) pair, so that a service with a large share of all requests is spread over its
slices, and it is dropped by a timer once the watermark has passed the slice. The cells of a slice lie in ``BUCKETS`` buckets of
services, one state each: reading and writing state costs milliseconds, a cell in it microseconds. Each micro-batch emits the
cells it changed; a service's figures are an aggregate over its cells, which are short rows. Latencies are summed with what
rounding leaves out, so that the mean does not depend on the order of the requests or on the slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cellarmark.session import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 64
SUMS = ["service", "total", "successful", "timed", "latency", "rest", "ok_micros", "ok_event", "settled"]
STATE = ", ".join(f"{c} array<{'double' if c in ('latency', 'rest') else 'long'}>" for c in [*SUMS, "fail_service", "fail_micros", "fail_event"])
CELL = "service long, slice long, total long, successful long, timed long, latency double, rest double, any_ok boolean, tail long"


class RequestCells(StatefulProcessor):
    """The cells of one bucket and slice: sums of each, its last success, and its failures after that.

    A failure the watermark has passed can only be undone by a success that is later still, so it is kept as a number;
    positions are kept for the failures of the last ``delay`` alone. That bounds the state whatever the length of a streak.
    """

    def __init__(self, slice_seconds: int):
        self.slice_seconds = slice_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getValueState("cells", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = not self.cells.exists()
        sums: dict[int, list] = {}
        failures: dict[int, list[tuple[int, int]]] = {}
        if not new:
            *stored, fail_service, fail_micros, fail_event = self.cells.get()
            sums = {row[0]: list(row[1:]) for row in zip(*stored)}
            for service, *failure in zip(fail_service, fail_micros, fail_event):
                failures.setdefault(service, []).append(tuple(failure))
        changed = set()
        for frame in rows:
            columns = [frame[c].tolist() for c in ("service", "micros", "event_id", "latency")]
            outcome = frame["ok"].astype("boolean").astype("object").tolist()
            for service, micros, event, latency, ok in zip(*columns, outcome):
                changed.add(service)
                cell = sums.setdefault(service, [0, 0, 0, 0.0, 0.0, None, None, 0])
                cell[0] += 1
                if latency is not None and latency == latency:
                    cell[2] += 1
                    total = cell[3] + latency
                    back = total - cell[3]
                    cell[4] += (cell[3] - (total - back)) + (latency - back)
                    cell[3] = total
                if ok is True:
                    cell[1] += 1
                    if cell[5] is None or (micros, event) > (cell[5], cell[6]):
                        cell[5:] = micros, event, 0
                elif ok is False:
                    failures.setdefault(service, []).append((micros, event))
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        out = []
        for service, cell in sums.items():
            after = failures.get(service, [])
            if cell[5] is not None:
                after = [f for f in after if f > (cell[5], cell[6])]
            if service in changed:
                out.append((service, int(key[1]), *cell[:5], cell[5] is not None, cell[7] + len(after)))
            cell[7] += sum(1 for f in after if f[0] <= passed)
            failures[service] = [f for f in after if f[0] > passed]
        held = [(service, *f) for service, after in failures.items() for f in after]
        stored = [list(c) for c in zip(*((service, *cell) for service, cell in sums.items()))]
        self.cells.update((*stored, *([f[n] for f in held] for n in range(3))))
        if new:
            self.handle.registerTimer((int(key[1]) + 1) * self.slice_seconds * 1000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CELL.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.cells.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_cells(log: DataFrame, delay: str = "10 minutes", slice_seconds: int = 3600) -> DataFrame:
    """Changed cells of a request stream (service, ts, event_id, ok, latency), for update mode.

    Ties in time go by event_id. A request without a time is left out; one whose time the watermark (the largest time seen
    before this micro-batch, less ``delay``) has passed is dropped as late. A null outcome is neither success nor failure, a null
    latency does not count in the mean. Needs the RocksDB state store (:func:`use_rocksdb`).
    """
    timed = log.select("service", F.col("ts").cast("timestamp").alias("ts"), "event_id", "ok", "latency").filter(F.col("ts").isNotNull())
    micros = F.unix_micros("ts")
    place = {"micros": micros, "slice": F.floor(micros / (slice_seconds * 1_000_000)), "bucket": F.pmod(F.xxhash64("service"), F.lit(BUCKETS))}
    return timed.withWatermark("ts", delay).withColumns(place).groupBy("bucket", "slice").transformWithStateInPandas(
        RequestCells(slice_seconds), outputStructType=CELL, outputMode="update", timeMode="eventTime"
    )


def use_rocksdb(spark: SparkSession) -> None:
    """Queries started from this session afterwards keep their state in RocksDB, on disk and with change logs."""
    spark.conf.set(PROVIDER, ROCKSDB)


def keep_cells(cells: DataFrame, folder: str, checkpoint: str, available_now: bool = False):
    """Write each micro-batch's changed cells to a folder of its number; a replayed batch overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = cells.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell as of the last micro-batch that changed it."""
    columns = [c.split()[0] for c in CELL.split(", ")]
    stored = spark.read.schema(f"{CELL}, batch long").parquet(folder)
    rest = F.struct(*[c for c in columns if c not in ("service", "slice")])
    return stored.groupBy("service", "slice").agg(F.max_by(rest, "batch").alias("c")).select("service", "slice", "c.*")


def replayed_metrics(log: DataFrame, delay: str = "10 minutes", slice_seconds: int = 7 * 86400) -> DataFrame:
    """Metrics of a bounded stream read to its end; cells and checkpoint are kept in a new folder of the shared one."""
    spark = log.sparkSession
    root = f"{shared_folder(spark)}/sessions-{uuid4().hex}"
    before = spark.conf.get(PROVIDER)
    use_rocksdb(spark)
    try:
        query = keep_cells(stream_cells(log, delay, slice_seconds), f"{root}/cells", f"{root}/checkpoint", True)
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return metrics_of_cells(latest_cells(spark, f"{root}/cells"))


def _exact_sum(parts: Column) -> Column:
    """Sum of (latency, rest) pairs with the rounding errors of its steps added up beside it; of infinite sums no rest counts."""

    def add(acc: Column, part: Column) -> Column:
        total = acc["s"] + part["latency"]
        back = total - acc["s"]
        return F.struct(total.alias("s"), (acc["e"] + (acc["s"] - (total - back)) + (part["latency"] - back) + part["rest"]).alias("e"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e"))
    return F.aggregate(parts, zero, add, lambda acc: acc["s"] + F.when(F.isnan(acc["e"]), 0.0).otherwise(acc["e"]))


def metrics_of_cells(cells: DataFrame) -> DataFrame:
    """Totals, success rate, mean latency and current failure streak per service, as request_log.session_metrics gives them."""
    totals = cells.groupBy("service").agg(
        F.sum("total").alias("total"), F.sum("successful").alias("successful"),
        F.round(F.try_divide(_exact_sum(F.collect_list(F.struct("latency", "rest"))), F.sum("timed")), 4).alias("avg_latency"),
        F.max(F.when(F.col("any_ok"), F.col("slice"))).alias("last_ok"),
    )
    since = F.col("last_ok").isNull() | (F.col("slice") >= F.col("last_ok"))
    streak = cells.join(totals.select("service", "last_ok"), "service").filter(since).groupBy("service").agg(F.sum("tail").alias("failure_streak"))
    return totals.join(streak, "service", "left").select(
        "service", "total", "successful", F.round(F.col("successful") / F.col("total") * 100, 2).alias("success_rate"),
        "avg_latency", F.coalesce("failure_streak", F.lit(0)).alias("failure_streak"),
    )
