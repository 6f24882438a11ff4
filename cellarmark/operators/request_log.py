"""Request-log measures: trailing counts, bursts, success metrics, failure streaks, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, FIVE_MINUTES = 3600, 300


CELLS_PER_SPAN = 64


def running_counts(log: DataFrame, seconds: int) -> DataFrame:
    """(service, _t, requests): requests in the trailing window at every time, in microseconds, at which a service has any.

    A sweep: a request adds one at its time and takes it away a window later. Steps at the same time are summed before the
    shuffle; they are then added up within (service, cell) pieces of a 64th of the window, and the cells' totals, one short row
    each, give what came before. A service with all requests is so spread over its cells.
    """
    span = seconds * 1_000_000
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    steps = F.array(F.struct(time.alias("_t"), F.lit(1).alias("by")), F.struct((time + span).alias("_t"), F.lit(-1).alias("by")))
    taken = log.select("service", F.explode(steps).alias("s")).filter(F.col("s._t").isNotNull())
    sums = taken.groupBy("service", F.col("s._t").alias("_t")).agg(F.sum("s.by").alias("_by"), F.count_if(F.col("s.by") > 0).alias("_new"))
    sums = sums.withColumn("_cell", F.floor(F.col("_t") / F.lit(max(span // CELLS_PER_SPAN, 1))))
    totals = sums.groupBy("service", "_cell").agg(F.sum("_by").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("service").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("service").alias("_s"), F.col("_cell").alias("_c"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_by").over(Window.partitionBy("service", "_cell").orderBy("_t"))
    same = F.col("service").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c"))
    joined = sums.withColumn("_inside", inside).join(totals, same)
    return joined.filter("_new > 0").select("service", "_t", (F.col("_inside") + F.col("_before")).alias("requests"))


def trailing_counts(log: DataFrame, seconds: int, name: str) -> DataFrame:
    """Requests of the same service in the trailing window, the current one and those of the same time included.

    Rows meet their counts by (service, time); a row without a time gets null, rows without a service are one service.
    """
    counts = running_counts(log, seconds).select(F.col("service").alias("_s"), F.col("_t").alias("_u"), F.col("requests").alias(name))
    timed = log.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    same = F.col("service").eqNullSafe(F.col("_s")) & (F.col("_t") == F.col("_u"))
    return timed.join(counts, same, "left").select(*log.columns, name)


def rate_limit_flags(log: DataFrame, hourly_limit: int, burst_limit: int = 10) -> DataFrame:
    hourly = trailing_counts(log, HOUR, "last_hour")
    both = trailing_counts(hourly, FIVE_MINUTES, "last_five_minutes")
    return both.withColumns(
        {"over_limit": F.col("last_hour") >= hourly_limit, "burst": F.col("last_five_minutes") >= burst_limit}
    )


def session_metrics(log: DataFrame) -> DataFrame:
    """Totals, success rate, mean latency and current failure streak per service."""
    order = F.struct("ts", "event_id")
    totals = log.groupBy("service").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("successful"),
        F.round(F.avg("latency"), 4).alias("avg_latency"),
        F.max(F.when(F.col("ok"), order)).alias("_last_ok"),
    )
    after = (
        log.filter(~F.col("ok"))
        .join(totals.select("service", "_last_ok"), "service")
        .filter(F.col("_last_ok").isNull() | (order > F.col("_last_ok")))
        .groupBy("service")
        .agg(F.count("*").alias("failure_streak"))
    )
    return totals.join(after, "service", "left").select(
        "service", "total", "successful",
        F.round(F.col("successful") / F.col("total") * 100, 2).alias("success_rate"),
        "avg_latency", F.coalesce("failure_streak", F.lit(0)).alias("failure_streak"),
    )


def failure_streaks(log: DataFrame, slice_by: Column) -> DataFrame:
    """Length of the failure streak at every request.

    Inside a (service, slice) cell the streak is counted from the last success of the cell; cells
    without an earlier success add the carry of the preceding cells.
    """
    sliced = log.withColumns({"_slice": slice_by, "_fail": (~F.col("ok")).cast("int"), "_ok": F.col("ok").cast("int")})
    cell = Window.partitionBy("service", "_slice").orderBy("ts", "event_id")
    sliced = sliced.withColumn("_island", F.sum("_ok").over(cell))
    local = F.sum("_fail").over(Window.partitionBy("service", "_slice", "_island").orderBy("ts", "event_id"))
    sliced = sliced.withColumn("_local", local)
    cells = sliced.groupBy("service", "_slice").agg(
        F.max("_ok").alias("_any_ok"), F.max_by("_local", F.struct("ts", "event_id")).alias("_tail")
    )
    along = Window.partitionBy("service").orderBy("_slice")
    cells = cells.withColumn("_run", F.sum("_any_ok").over(along))
    run = Window.partitionBy("service", "_run").orderBy("_slice")
    cells = cells.withColumn("_end", F.sum("_tail").over(run))
    carry = cells.withColumn("_carry", F.coalesce(F.lag("_end").over(along), F.lit(0))).select("service", "_slice", "_carry")
    streak = F.col("_local") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    return sliced.join(carry, ["service", "_slice"]).withColumn("failure_streak", streak).select(*log.columns, "failure_streak")


def retain(log: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return log.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def cached_results(stored: DataFrame, queries: DataFrame, as_of: Column, days: int, prefix: str = "") -> DataFrame:
    """Stored results found again by md5 key while younger than ``days``."""
    keyed = queries.withColumn("cache_key", F.md5(F.concat(F.lit(prefix), F.col("query"))))
    fresh = stored.filter(F.col("ts") > as_of - F.make_dt_interval(F.lit(days)))
    return keyed.join(fresh, "cache_key")
