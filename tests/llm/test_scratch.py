"""Stored intermediates leave the shared folder once what is made of them is stored."""

import os

from cellarmark.llm import minmax, quality
from cellarmark.llm.common import ROW, discard, numbered, stored
from cellarmark.session import shared_folder


def labels_in(spark, before):
    return {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_folder(spark))) - before}


def docs_of(spark):
    rows = [(n, "the wine of the valley is red and the hill is green " * (1 + n % 5) + str(n), "en") for n in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_the_classifier_leaves_scores_and_thresholds_only(spark):
    before = set(os.listdir(shared_folder(spark)))
    labels = spark.createDataFrame([(n, 1, 0) for n in range(50)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs_of(spark), labels).count() == 60
    kinds = {name for name in labels_in(spark, before) if name.startswith("quality")}
    assert kinds == {"quality-scores", "quality-thresholds"}


def test_near_duplicates_leave_no_sets_and_buckets(spark):
    before = set(os.listdir(shared_folder(spark)))
    got = minmax.near_duplicates(numbered(docs_of(spark)).select(ROW, "doc_id", "text"), width=3, percent=85, bands=40, rows=6)
    assert got.count() == 60
    assert labels_in(spark, before).isdisjoint({"minmax-sets", "minmax-buckets", "minmax-links"})


def test_discarded_tables_are_gone_and_others_stay(spark):
    one, two = stored(spark.range(9).distinct().toDF("n"), "one"), stored(spark.range(5).toDF("n"), "two")
    discard(one)
    assert not os.path.exists(one.stored_at.removeprefix("file://")) and two.count() == 5
