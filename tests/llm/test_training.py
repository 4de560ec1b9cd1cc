"""The classifiers' sample: of the labelled rows at hand, and whole beside very long texts."""

import pytest
from pyspark.sql import functions as F

from loomtide.llm import training


def rows(spark, n, long=()):
    docs = spark.createDataFrame([(k, "x" * 5000 if k in long else f"t{k}") for k in range(n)], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, k % 2) for k in range(n)], "doc_id long, quality int")


@pytest.mark.parametrize("long", [range(0, 300, 7), range(0, 300, 2)])
def test_long_texts_are_passed_over(spark, monkeypatch, long):
    monkeypatch.setattr(training, "MAX_BYTES", 4000)
    docs, labels = rows(spark, 300, set(long))
    texts, y, _ = training.sample(docs, labels, "quality", 5, 0)
    short = docs.where(~training.held_out(5, 0) & (F.length("text") < 5000)).count()
    assert len(texts) == short and max(map(len, texts)) < 5000


def test_each_class_has_its_share_of_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(training, "MAX_BYTES", 12000)
    docs, labels = rows(spark, 300, set(range(0, 300, 2)))
    _, y, _ = training.sample(docs, labels, "quality", 5, 0)
    assert (y == 0).sum() == 2 and (y == 1).sum() > 100


def test_sample_and_share_are_of_the_rows_at_hand(spark):
    docs, labels = rows(spark, 300)
    few = docs.where("doc_id % 2 = 1 or doc_id < 100")
    texts, y, share = training.sample(few, labels, "quality", 5, 0, 20)
    there = few.join(labels, "doc_id").where(~training.held_out(5, 0))
    assert (y == 0).sum() == 20 == (y == 1).sum() and share == there.where("quality = 1").count() / there.count()
