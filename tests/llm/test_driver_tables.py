"""Joins of tables that grow with the corpus build no hash table on the driver, however small the tables are."""

from cellarmark.llm import minmax, quality
from cellarmark.llm.common import ROW, merged, numbered, stored, table


def watch(monkeypatch, module, name, plans):
    make = getattr(module, name)

    def noted(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return make(df, *rest)

    monkeypatch.setattr(module, name, noted)


def test_near_duplicates_broadcast_nothing(spark, sf_dir, monkeypatch):
    rows = [(n, f"{'the wine of the valley is red and the hill is green ' * 9} {n % 7}", "en") for n in range(60)]
    docs = numbered(stored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs"))
    plans = []
    watch(monkeypatch, minmax, "stored", plans)
    watch(monkeypatch, minmax, "cut_lineage", plans)
    # the texts' own joins are left to Spark
    monkeypatch.setattr(minmax, "full_sets", lambda docs, wanted, width, make=minmax.full_sets: plans.append(wanted._jdf.queryExecution().executedPlan().toString()) or stored(make(docs, wanted, width), "sets"))
    got = minmax.near_duplicates(docs.select(ROW, "doc_id", "text"), width=3, percent=85, bands=40, rows=6)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert got.select("class").distinct().count() < 60 == got.count()
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert len(joins) > 8 and not any("BroadcastHashJoin" in p for p in joins)


def test_the_model_is_joined_without_broadcasts_of_its_tables(spark, sf_dir, monkeypatch):
    plans = []
    watch(monkeypatch, quality, "stored", plans)
    docs = table(spark, sf_dir, "documents")
    counts = quality.count_ngrams(docs.select("lang", "text"))
    model = quality.kneser_ney(counts)
    assert model.count() > 0
    # one for each order's discounts, a row for each language
    assert sum(p.count("BroadcastHashJoin") for p in plans) <= 2 * quality.ORDER
    assert any("SortMergeJoin" in p for p in plans)


def test_merged_keeps_the_rows_of_each_kind_of_join(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, x string"), spark.createDataFrame([(2, "p"), (3, "q")], "k long, y string")
    for how in ("inner", "left", "full", "left_semi"):
        assert sorted(map(str, merged(left, right, "k", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
