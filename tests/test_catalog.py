"""Catalog queries against their SQL equivalents, on whole tables of the smallest scale."""

import math

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(tuple(canonical(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(canonical(r[columns.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want


def test_entry_runs(spark, sf_dir):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_no_cross_join_of_tables(spark, sf_dir):
    """Nested-loop joins appear only where one side is a single-row aggregate."""
    for name in ("facet_counts", "brand_summary", "enhanced_confidence", "priority_rank", "domain_hierarchy", "brand_merge"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
