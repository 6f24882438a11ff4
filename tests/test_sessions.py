"""Streaming sessions against the batch query on the same log; late rows, odd rows, streaks across slices and batches."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from cellarmark.operators import request_log
from cellarmark.plans.registry import Registry
from cellarmark.streaming import sessions

LOG = "service long, ts timestamp, event_id long, ok boolean, latency double"
START = dt.datetime(2024, 1, 1)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def state_store(spark):
    before = spark.conf.get(PROVIDER)
    sessions.use_rocksdb(spark)
    yield
    spark.conf.set(PROVIDER, before)


def replay(spark, folder, batches, delay="10 minutes", slice_seconds=3600):
    """Metrics after each list of rows has come as a micro-batch of its own."""
    source = str(folder / "in")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{source}/b={n}")
        stream = spark.readStream.schema(LOG).parquet(f"{source}/b=*")
        query = sessions.keep_cells(sessions.stream_cells(stream, delay, slice_seconds), str(folder / "cells"), str(folder / "ck"), True)
        assert query.awaitTermination(120) and query.exception() is None
    return sorted(map(tuple, sessions.metrics_of_cells(sessions.latest_cells(spark, str(folder / "cells"))).collect()))


def batch(spark, rows):
    return sorted(map(tuple, request_log.session_metrics(spark.createDataFrame(rows, LOG)).collect()))


def at(seconds, event, ok, service=1, latency=1.0):
    return (service, START + dt.timedelta(seconds=seconds), event, ok, latency)


def test_streaks_over_slices_and_batches(spark, tmp_path):
    first = [at(10, 1, True), at(20, 2, False), at(3700, 3, False), at(7300, 4, False), at(50, 5, False, 2), at(60, 6, False, 2)]
    # out of order within the delay: a success between the failures, a tie in time decided by the id
    second = [at(7000, 7, True), at(7300, 8, True), at(7300, 9, False), at(7400, 10, None, 1, None), at(7500, 11, False, 2)]
    third = [at(11000, 12, False), at(11001, 13, True, 3)]
    assert replay(spark, tmp_path, [first, second, third]) == batch(spark, first + second + third)


def test_late_and_timeless_rows_are_left_out(spark, tmp_path):
    first = [at(0, 1, True), at(10, 2, False), at(20000, 3, False)]
    late = [at(30, 4, True), (1, None, 5, True, 9.0), at(19950, 6, True)]
    kept = [*first, late[2]]
    assert replay(spark, tmp_path, [first, [at(20001, 7, False)], late]) == batch(spark, [*kept, at(20001, 7, False)])


def test_state_of_one_long_streak_stays_short(spark, tmp_path):
    rounds = [[at(600 * n + k, 1000 * n + k, False) for k in range(300)] for n in range(4)]
    assert replay(spark, tmp_path, rounds, "1 minute", 86400) == [(1, 1200, 0, 0.0, 1.0, 1200)]


def test_replayed_table_equals_the_batch_query(spark, sf_dir, tmp_path):
    log = Registry(spark, sf_dir).requests.select("service", F.col("ts").cast("timestamp").alias("ts"), "event_id", "ok", "latency")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    # files in any order: nothing is late within the whole span
    query = sessions.keep_cells(sessions.stream_cells(stream, "60 days", 7 * 86400), str(tmp_path / "cells"), str(tmp_path / "ck"), True)
    assert query.awaitTermination(200) and query.exception() is None
    got = sessions.metrics_of_cells(sessions.latest_cells(spark, str(tmp_path / "cells")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, request_log.session_metrics(log).collect()))
    shutil.rmtree(tmp_path / "log")


def test_mean_does_not_depend_on_the_slices(spark, tmp_path):
    # sums of such numbers in doubles end beside the exact 46.99625, whose fourth decimal the mean is rounded at
    values = [0.1, 0.2, 0.3, 1e9 + 0.7, 93.99, 31.41, 7.77]
    exact = round(46.99625 * 8 - sum(values[k] for k in (0, 1, 2, 4, 5, 6)) - 0.7, 2)
    values += [exact - 1e9]
    rows = [at(4000 * n, n, n % 3 > 0, s, v) for s in range(1, 40) for n, v in enumerate(values[s % 8 :] + values[: s % 8])]
    got = replay(spark, tmp_path, [rows[::2], rows[1::2]], "60 days")
    assert len(got) == 39 and {(r[1], r[4]) for r in got} == {(8, 46.9963)}
