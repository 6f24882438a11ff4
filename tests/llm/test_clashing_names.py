"""Tables with extra columns named like the operators' own ones give the same rows."""

import pytest
from pyspark.sql import functions as F

from cellarmark.llm import common, registry
from cellarmark.session import shared_folder


@pytest.fixture(scope="module")
def clashing(spark, sf_dir):
    path = f"{shared_folder(spark)}/clashing"
    for name in ("documents", "benchmark", "labels"):
        frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        extra = {c: F.lit("x") for c in ("_row", "_file", "_place", "_number", "node", "class", "hits", "row", "item")}
        frame.withColumns(extra).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["op1_minmax_near_dedup", "op2_kneser_ney_quality", "op6_containment_search"])
def test_same_rows(spark, sf_dir, clashing, name):
    plain, other = (sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in registry.QUERIES[name](spark, d).collect()), key=str) for d in (sf_dir, clashing))
    assert plain == other


def test_rows_are_numbered_beside_clashing_columns(spark, clashing):
    docs = spark.read.parquet(f"{clashing}/documents.parquet").drop("_row")
    rows = common.numbered(docs)
    assert rows.columns == [*docs.columns, common.ROW] or set(rows.columns) == {*docs.columns, common.ROW}
    assert rows.select(common.ROW).distinct().count() == docs.count()
    assert {r["_file"] for r in rows.select("_file").distinct().collect()} == {"x"}
