"""Uploads, snapshots, exports, and streams that must equal their batch form."""

import pytest
from pyspark.sql import functions as F

from cellarmark import rules
from cellarmark.operators import insights, learning, permits
from cellarmark.plans.registry import Registry
from cellarmark.sources import delimited, snapshots
from cellarmark.streaming import jobs

LABELS = """TTB ID;Product;brand_name;Permit No;Approval Date
1;Fox Red;FOX;ca-i-1;1/2/2020
2;Oak Gin;OAK;TX-I-2;3/4/2021
3;Elm;ÉLM;zz-i-9;
"""
HOLDERS = "Permit_Number,Owner_Name,State\nCA-I-1,ACME,CA\ntx-i-2 ,BETA,TX\nTX-I-2,BETA TWO,TX\n"


def test_upload_with_odd_encoding_and_delimiter(spark, tmp_path):
    path = tmp_path / "20250808_labels.csv"
    path.write_bytes(LABELS.encode("latin-1"))
    assert delimited.detect_encoding(spark, str(path)) == "iso-8859-1"
    df = delimited.read_table(spark, str(path))
    labels = delimited.label_upload(df)
    rows = {r["ttb_id"]: (r["permit_no"], r["brand_name"]) for r in labels.collect()}
    assert rows == {"1": ("CA-I-1", "FOX"), "2": ("TX-I-2", "OAK"), "3": ("ZZ-I-9", "ÉLM")}
    version = spark.createDataFrame([(str(path),)], "p string").select(snapshots.version_of_file(F.col("p"))).first()[0]
    assert version == "20250808"


def test_match_fans_out_on_duplicate_holders(spark, tmp_path):
    (tmp_path / "l.csv").write_text(LABELS, encoding="utf-8")
    (tmp_path / "h.csv").write_text(HOLDERS, encoding="utf-8")
    labels = delimited.label_upload(delimited.read_table(spark, str(tmp_path / "l.csv")))
    holders = delimited.read_table(spark, str(tmp_path / "h.csv"))
    matched = permits.match_permits(labels, holders, "permit_no", permits.permit_key_column(holders))
    status = sorted((r["ttb_id"], r["Match_Status"]) for r in matched.collect())
    assert status == [("1", "Matched"), ("2", "Matched"), ("2", "Matched"), ("3", "No Match")]
    assert permits.match_summary(matched).first()["match_rate"] == 75.0


def test_missing_required_column_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "thing string")
    try:
        delimited.map_headers(df, rules.REQUIRED_LABEL_COLUMNS, [], rules.LABEL_COLUMN_ALIASES)
    except ValueError as err:
        assert "Permit No." in str(err)
    else:
        raise AssertionError("missing columns were accepted")


def test_contact_headers(spark):
    df = spark.createDataFrame([("FOX", "A B", "a@b", "CEO", "x")], "`Company` string, `Full Name` string, `Work Email` string, `Job Title` string, `LinkedIn Profile` string")
    assert set(delimited.contact_upload(df).columns) == {"brand_name", "contact_name", "email", "title", "linkedin"}


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("a,b\n1,2\n3,4,5\n6,7\n", encoding="utf-8")
    good, bad = delimited.split_malformed(spark, str(path), ["a", "b"])
    assert sorted(r["a"] for r in good.collect()) == ["1", "6"]
    assert [r["_corrupt_record"] for r in bad.collect()] == ["3,4,5"]


def test_snapshots_and_exports(spark, tmp_path, sf_dir):
    root = str(tmp_path / "snap")
    one = spark.createDataFrame([("p1", "x")], "permit_number string, owner_name string")
    two = spark.createDataFrame([("p1", "y"), ("p2", "z")], "permit_number string, owner_name string")
    snapshots.write_snapshot(one, root, "20240101", "a.csv")
    snapshots.write_snapshot(two, root, "20250101", "b.csv")
    assert snapshots.read_snapshot(spark, root).count() == 2
    assert snapshots.read_snapshot(spark, root, "20240101").count() == 1
    r = Registry(spark, sf_dir)
    bridge = r.brand_permits.join(r.importers, F.col("permit_no") == F.col("permit_number")).select("brand_name", "permit_no", "owner_name")
    views = snapshots.export_views(r.brand_names, r.skus, bridge, r.importers)
    with_, without = views["brands_with_importers"].count(), views["brands_without_importers"].count()
    assert with_ + without == r.brand_names.count()
    snapshots.write_csv(views["importer_rankings"], str(tmp_path / "rank"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rank")).count() == views["importer_rankings"].count()


def test_learning_export(spark, tmp_path, sf_dir):
    r = Registry(spark, sf_dir)
    terms = spark.createDataFrame([("t", "product_type", 1.0, 2)], "term string, term_type string, success_rate double, sample_count long")
    strategies = spark.createDataFrame([("s", 1.0, 0.5, 3)], "strategy string, success_rate double, average_confidence double, sample_count long")
    tables = learning.export_tables(r.feedback, learning.domain_patterns(r.feedback), terms, strategies)
    for name, df in tables.items():
        snapshots.write_csv(df, str(tmp_path / name))
    assert spark.read.option("header", True).csv(str(tmp_path / "learning_events")).count() == r.feedback.count()


def test_stream_patterns_equal_batch(spark, sf_dir):
    r = Registry(spark, sf_dir)
    schema = r.table("events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")

    class Live(Registry):
        def table(self, name):
            return stream if name == "events" else super().table(name)

    live = Live(spark, sf_dir).feedback.withColumn("ts", F.col("ts").cast("timestamp"))
    got = jobs.run_to_memory(jobs.stream_patterns(live), "stream_patterns", "complete")
    want = learning.domain_patterns(r.feedback)
    cols = ["pattern_type", "pattern", "sample_count", "success_rate", "confidence_boost"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_stream_windows_cover_every_request(spark, sf_dir):
    r = Registry(spark, sf_dir)
    stream = spark.readStream.schema(r.table("events").schema).parquet(f"{sf_dir}/events.parquet*")

    class Live(Registry):
        def table(self, name):
            return stream if name == "events" else super().table(name)

    log = Live(spark, sf_dir).requests.withColumn("ts", F.col("ts").cast("timestamp"))
    got = jobs.run_to_memory(jobs.stream_request_counts(log, length="1 hour", slide="1 hour"), "stream_counts", "complete")
    batch = r.requests.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "service").agg(F.count("*").alias("requests"))
    assert sorted(r_["requests"] for r_ in got.collect()) == sorted(r_["requests"] for r_ in batch.collect())


def test_stream_ingestion_equals_one_upsert(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "snap")
    schema = "ttb_id string, brand_name string, file_order int"
    spark.createDataFrame([("1", "A", 1), ("2", "B", 2)], schema).coalesce(1).write.mode("append").json(source)

    def drain():
        uploads = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        q = jobs.ingest_labels(uploads, root, str(tmp_path / "ck"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    drain()
    spark.createDataFrame([("2", "X", 1), ("2", "Y", 2), ("3", "C", 3)], schema).coalesce(1).write.mode("append").json(source)
    drain()
    rows = {r["ttb_id"]: r["brand_name"] for r in jobs.latest_labels(spark, root).collect()}
    assert rows == {"1": "A", "2": "Y", "3": "C"}


def test_report_date_filter(spark):
    skus = spark.createDataFrame([("A", "1/5/2020"), ("A", "12/31/2020"), ("B", "bad"), ("B", "")], "brand_name string, completed_date string")
    assert insights.dated(skus, "2020-01-01", "2020-06-30").count() == 1
    assert insights.brands_with_dates(skus.select("brand_name").distinct(), skus).count() == 2


def test_a_cluster_without_a_shared_folder_is_refused():
    """Only a local session may fall back to a temporary folder."""
    from types import SimpleNamespace

    from cellarmark.session import shared_folder

    def session(master, folder=None):
        known = {"spark.master": master} | ({"spark.checkpoint.dir": folder} if folder else {})
        return SimpleNamespace(conf=SimpleNamespace(get=known.get), sparkContext=SimpleNamespace(applicationId=master))

    assert shared_folder(session("yarn", "hdfs://x/y")) == "hdfs://x/y"
    assert shared_folder(session("local[2]")) == shared_folder(session("local[2]"))
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://host:7077"))
