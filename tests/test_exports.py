"""Exports of several tables at once, and uploads that need cleaning."""

import shutil

import pytest

from cellarmark.sources import delimited
from cellarmark.sources.exports import export_all, export_manifest, read_export


def tables(spark, n):
    one = spark.createDataFrame([(f"B{k}", k) for k in range(n)], "brand string, skus int")
    two = spark.createDataFrame([('say "hi", all', None)], "text string, note string")
    return {"brands": one, "notes": two, "none": one.limit(0)}


def test_a_broken_export_leaves_the_old_one(spark, tmp_path):
    root = str(tmp_path / "x")
    assert export_manifest(spark, root).count() == 0
    with pytest.raises(FileNotFoundError):
        read_export(spark, root, "brands")
    assert export_all(spark, tables(spark, 3), root) == 0
    broken = tables(spark, 5) | {"notes": spark.sql("SELECT CAST(raise_error('disk is full') AS STRING) AS text, 1 AS note")}
    with pytest.raises(Exception, match="disk is full"):
        export_all(spark, broken, root)
    assert read_export(spark, root, "brands").count() == 3
    assert export_all(spark, tables(spark, 7), root) == 1
    assert {r["table"]: r["row_count"] for r in export_manifest(spark, root).collect()} == {"brands": 7, "notes": 1, "none": 0}
    assert read_export(spark, root, "brands").count() == 7 and read_export(spark, root, "brands", 0).count() == 3
    assert [tuple(r) for r in read_export(spark, root, "notes").collect()] == [('say "hi", all', None)]
    assert read_export(spark, root, "none").columns == ["brand", "skus"] and read_export(spark, root, "none").count() == 0
    with pytest.raises(FileNotFoundError):
        read_export(spark, root, "other")
    shutil.rmtree(f"{root}/head/commit=1")
    assert read_export(spark, root, "brands").count() == 3


def test_rows_that_fit_once_cleaned(spark, tmp_path):
    path = tmp_path / "l.csv"
    lines = ["TTB ID,Brand\x00 Name,Permit No", "1,FO\x00X,CA-1", '2,""OAK, OLD"",CA-2', '3,"ELM ""RED""",CA-3', "# a comment", "4,a,b,c,d", "", "5,ASH,nan", "6"]
    path.write_text("\n".join(lines), encoding="utf-8")
    table, rejected = delimited.read_with_rejects(spark, str(path), "utf-8", ",")
    assert table.columns == ["TTB ID", "Brand Name", "Permit No"]
    got = {r["TTB ID"]: (r["Brand Name"], r["Permit No"]) for r in table.collect()}
    assert got == {"1": ("FOX", "CA-1"), "2": ("OAK, OLD", "CA-2"), "3": ('ELM "RED"', "CA-3"), "5": ("ASH", None)}
    assert sorted(r["_corrupt_record"] for r in rejected.collect()) == ["4,a,b,c,d", "6"]
