"""Toxicity: held-out accuracy, shared weights with ordered thresholds, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 4 > 0"))
    assert list(model.thresholds) == sorted(model.thresholds) and min(model.weights.values()) > 0
    held = labels.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    got = toxicity.score(docs, model).join(held, F.col("doc_id") == F.col("id")).collect()
    caught = np.mean([r.toxic for r in got if r.y == 1])
    wrong = np.mean([r.toxic for r in got if r.y == 0])
    assert caught > 0.75 and wrong < 0.01
    severe = {r.doc_id: r.severity for r in got}
    assert all(0 <= v <= toxicity.GRADES - 1 for v in severe.values())


def test_planted_rows(spark, labels):
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    rows = [(1, "you are a moron and a pathetic idiot, worthless scum"), (2, "a quiet text about rivers and hills"), (3, None), (4, ""), (5, "quiet words " * 40_000)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].toxic and got[1].grade >= 1 and not any(got[i].toxic for i in (2, 3, 4, 5))
    assert got[3].severity == got[4].severity == got[5].severity


def test_ordinal_fit_recovers_order():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 6, 600)
    grade = np.clip(x // 2, 0, 3)
    rows = np.flatnonzero(x)
    weights, cuts = toxicity.fit_ordinal((rows, np.zeros(len(rows), int), x[rows].astype(float), 1), grade)
    assert weights[0] > 0 and np.all(np.diff(cuts) > 0)
    predicted = (weights[0] * x[:, None] > cuts[None, :]).sum(axis=1)
    assert np.mean(predicted == grade) > 0.9


@pytest.mark.parametrize("name", ["edge", "nothing"])
def test_edges(request, spark, name):
    docs = request.getfixturevalue(name)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 1)], "doc_id long, toxic int")
    for labels in (none, some):
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == docs.count() and not any(r.toxic for r in got if labels is none)
