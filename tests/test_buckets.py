"""Bucketed tables: commits of several tables, changed buckets only, replays, schema growth."""

import os
import shutil

import pytest

from cellarmark.sources.buckets import BucketStore
from cellarmark.streaming import jobs

LABEL = "ttb_id string, brand_name string, permit_no string, origin_desc string, file_order int"
MASTERS = "kind string, permit_number string"


def labels(spark, *rows):
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], LABEL)


def named(store, table, key):
    return {r[key]: r.asDict() for r in store.read(table).collect()}


def test_one_upload_changes_its_buckets_only(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), 64)
    many = labels(spark, *[(str(n), f"B{n % 40}", f"P{n % 7}", "FRANCE") for n in range(400)])
    assert jobs.apply_labels(store, many, "import", 0) == 0
    assert jobs.apply_labels(store, labels(spark, ("7", "NEW", "P9", "SPAIN")), "import", 1) == 1
    assert len(os.listdir(tmp_path / "s/data/labels/commit=0")) > 50
    assert [d for d in os.listdir(tmp_path / "s/data/labels/commit=1") if d.startswith("bucket=")] == [f"bucket={store.buckets_of(labels(spark, ('7', '', '', '')), 'ttb_id')[0]}"]
    now = named(store, "labels", "ttb_id")
    assert len(now) == 400 and now["7"]["brand_name"] == "NEW" and now["8"]["brand_name"] == "B8"
    brands = named(store, "brands", "brand_name")
    assert len(brands) == 41 and brands["NEW"]["permit_numbers"] == ["P9"] and brands["NEW"]["countries"] == ["SPAIN"]
    # the table before the second commit can still be read
    assert {r["ttb_id"]: r["brand_name"] for r in store.read("labels", commit=0).collect()}["7"] == "B7"


def test_replayed_batch_and_broken_attempt(spark, tmp_path):
    root = str(tmp_path / "s")
    store = BucketStore(spark, root, 8)
    first, second = labels(spark, ("1", "A", "P1", "FRANCE"), ("2", "B", "P2", "SPAIN")), labels(spark, ("2", "C", "P3", None), ("3", "A", "P4", "SPAIN"))
    jobs.apply_labels(store, first, "up", 0)
    jobs.apply_labels(store, second, "up", 1)
    # a crash before the head file: tables and manifest are there, the commit is not
    shutil.rmtree(f"{root}/head/commit=1")
    assert named(store, "labels", "ttb_id")["2"]["brand_name"] == "B" and store.appended("uploads").count() == 1
    assert jobs.apply_labels(store, second, "up", 1) == 1
    assert jobs.apply_labels(store, second, "up", 1) is None and jobs.apply_labels(store, first, "up", 0) is None
    assert {k: v["brand_name"] for k, v in named(store, "labels", "ttb_id").items()} == {"1": "A", "2": "C", "3": "A"}
    assert named(store, "brands", "brand_name")["A"]["permit_numbers"] == ["P1", "P4"]
    # another stream goes on top of what is there
    assert jobs.apply_labels(store, first, "other", 0) == 2
    assert named(store, "labels", "ttb_id")["2"]["brand_name"] == "B" and len(named(store, "labels", "ttb_id")) == 3


def test_history_counts_and_rejects(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), 8)
    masters = spark.createDataFrame([("importer", "P1"), ("spirit", "P2")], MASTERS)
    jobs.apply_labels(store, labels(spark, ("1", "A", "P1", None), (None, "X", "P1", None), ("2", None, "P2", None)), "up", 0, masters)
    jobs.apply_labels(store, labels(spark, ("1", "A", "P1", None), ("1", "A", "P2", None), ("4", "D", "P1", None)), "up", 1, masters)
    assert jobs.apply_labels(store, spark.createDataFrame([], LABEL), "up", 2, masters) is None
    got = {r["batch_id"]: r for r in store.appended("uploads").collect()}
    columns = ["total_records", "matched_records", "new_brands", "new_skus", "updated_skus", "rejected"]
    assert [got[0][c] for c in columns] == [2, 1, 2, 2, 0, 1]
    assert [got[1][c] for c in columns] == [3, 2, 1, 1, 2, 0]
    assert set(named(store, "brands", "brand_name")) == {"A", "D"}


def test_new_columns_of_a_later_upload(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), 4)
    jobs.apply_labels(store, labels(spark, ("1", "A", "P1", "FRANCE")).drop("origin_desc"), "up", 0)
    jobs.apply_labels(store, labels(spark, *[(str(n), "B", "P1", "SPAIN") for n in range(2, 9)]), "up", 1)
    now = named(store, "labels", "ttb_id")
    assert now["1"]["origin_desc"] is None and now["5"]["origin_desc"] == "SPAIN" and len(now) == 8


def test_rows_without_key_and_unknown_tables(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), 4)
    assert store.latest() is None and store.read("labels") is None
    with pytest.raises(FileNotFoundError):
        jobs.latest_labels(spark, store.root)
    with pytest.raises(Exception, match="row without k"):
        store.commit({"t": ("k", spark.createDataFrame([(None, 1)], "k string, v int"))})
    assert store.latest() is None
    store.commit({"t": ("k", spark.createDataFrame([("a", 1)], "k string, v int"))})
    assert [tuple(r) for r in store.read("t").collect()] == [("a", 1)]
