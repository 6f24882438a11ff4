"""A task runs one Python step at a time: each process stays alive with its memory, so a second one beside it doubles an executor's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarmark.llm import quality
from cellarmark.llm.bloom import holds
from cellarmark.llm.common import numbered, table


class Captured(Exception):
    pass


def side_by_side(plan, above=False):
    """Whether a Python step feeds another one without an exchange between them."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
        name = plan.nodeName()
    python = "MapIn" in name or "FlatMapGroups" in name
    if python and above:
        return True
    below = python or above and "Exchange" not in name
    return any(side_by_side(plan.children().apply(i), below) for i in range(plan.children().size()))


def executed(df):
    return df._jdf.queryExecution().executedPlan()


def test_known_texts_are_shuffled_between_filter_and_counts(spark, sf_dir, monkeypatch):
    seen = []

    def capture(counts):
        seen.append((side_by_side(executed(counts)), {(r["lang"], r["gram"]): r["c"] for r in counts.collect()}))
        raise Captured

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    monkeypatch.setattr(quality, "kneser_ney", capture)
    with pytest.raises(Captured):
        quality.classify(docs, labels)
    assert not seen[0][0]
    monkeypatch.setattr(quality, "HELD_GRAMS", 50)  # counts that are passed on early add up to the same
    with pytest.raises(Captured):
        quality.classify(docs, labels)
    assert seen[0][1] and seen[0] == seen[1]


def test_the_filter_of_the_model_is_one_python_step(spark, monkeypatch):
    rows = [("en", k, k * 1_000_003) for k in range(1, 6)] + [("", 0, 0)]
    entries = spark.createDataFrame(rows, "lang string, k int, gram long").coalesce(1)
    kind, plans = type(entries), []
    fetch = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: plans.append(side_by_side(executed(self))) or fetch(self))
    words = quality.filter_of(entries)
    assert plans == [False]
    for language, k, gram in rows:
        assert holds(words, quality.entry_hashes(language, k, np.array([gram], np.uint64))).all()


def test_row_numbers_take_no_python_process(spark, sf_dir):
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id"))
    assert "ExistingRDD" not in executed(rows).toString()
    assert rows.agg(F.count_distinct("_row")).first()[0] == rows.count() > 0
