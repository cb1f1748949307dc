"""Fitted models on held-out rows, and odd input."""
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.llm import ordinal, quality, toxicity

SF = "/root/testdata/sf0.1"
ODD = [(None, None), (900001, None), (900002, ""), (900003, "x" * 300_000), (900004, "\n \t"), (900005, "vile nasty grubby " * 3), (900005, "vile nasty grubby " * 3)]


def text(rng, n=60):
    return " ".join("".join(rng.choices("abcdefghinorst", k=rng.randint(2, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        t, q, x = text(rng, rng.randint(5, 80)), 1, 0
        if i % 6 == 0:
            x = 1
            t = " ".join(w + rng.choice(["", "", "", " vile", " nasty", " Grubby"]) for w in t.split()) + " vile"
        elif i % 5 == 0:
            q = 0
            t = rng.choice([t.upper().replace(" ", "!! "), " ".join([t.split()[0]] * 40), t.replace(" ", "### ")])
        docs.append((i, t))
        labels.append((i, q, x))
    frame = spark.createDataFrame(docs + ODD, "doc_id long, text string")
    known = spark.createDataFrame([r for r in labels if r[0] % 2 == 0] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return frame, known, {r[0]: r for r in labels}


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 4))
    grades = np.digitize(x @ [2, -1, 0, 0] + 0.1 * rng.standard_normal(600), [-1, 1])
    ids = np.tile(np.arange(4), 600)
    w, theta = ordinal.fit(ids, x.ravel(), np.arange(0, 2401, 4), grades, 4, 3)
    assert theta[0] < theta[1] and w[0] > 0 > w[1]
    p = ordinal.tails(x @ w, theta)
    assert (p[:, 0] >= p[:, 1]).all() and (np.abs(p.sum(axis=1) - grades) < 0.5).mean() > 0.9


def test_toxicity_held_out(corpus):
    docs, labels, truth = corpus
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.doc_id in truth and r.doc_id % 2]
    assert sum(r.toxic == bool(truth[r.doc_id][2]) for r in held) / len(held) > 0.97
    odd = [r for r in out if r.doc_id is None or r.doc_id > 900000]
    assert len(odd) == len(ODD) and {r.toxic for r in odd if r.doc_id != 900005} == {False} and all(0 <= r.severity <= 2 for r in out)
    assert [r.toxic for r in odd if r.doc_id == 900005] == [True, True]


def test_grades_come_from_the_other_half():
    """What a row's words say is counted on the labels of the other half alone."""
    rows = [np.array(x, dtype=np.int32) for x in ([1, 2, 9], [1, 9], [1, 2], [1, 9], [1, 2, 5], [9], [9, 8], [8])]
    toxic, half = np.array([1, 1, 1, 1, 1, 0, 0, 0], dtype=bool), np.array([0, 0, 1, 1, 1, 0, 1, 1])
    first = toxicity.graded(rows, toxic, half)
    assert first[~toxic].tolist() == [0, 0, 0] and set(first[toxic]) <= {1, 2}
    more = [r.copy() for r in rows]
    more[4] = np.array([1, 2, 5, 6, 7], dtype=np.int32)  # words that only this row has say nothing of it
    assert toxicity.graded(more, toxic, half).tolist() == first.tolist()
    assert toxicity.graded(rows, np.zeros(8, dtype=bool), half).tolist() == [0] * 8


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_toxicity_held_out_on_the_tables(spark):
    """Fitted on labels of even ids, scored on odd ones."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs.select("doc_id", "text"), labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id").groupBy("truth", "toxic").count().collect()
    n = {(r.truth, r.toxic): r["count"] for r in out}
    assert n[1, True] >= 0.9 * (n[1, True] + n[1, False]) and n.get((0, True), 0) <= 0.01 * n[0, False]


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, ordinal.labelled_sample(docs, labels, F.col("toxic"), 2, 5).collect())) == [(1, 1, "a"), (2, 0, None)]


def test_quality_held_out(corpus):
    docs, labels, truth = corpus
    out = quality.quality(docs, labels).collect()
    held = [r for r in out if r.doc_id in truth and r.doc_id % 2]
    good = [r for r in held if truth[r.doc_id][1]]
    assert sum(r.selected for r in good) / len(good) > 0.97
    assert sum(r.selected == bool(truth[r.doc_id][1]) for r in held) / len(held) > 0.95
    assert all(0 <= r.grade_tail <= 1 and r.grade_tail <= r.grade <= 2 for r in out) and len(out) == docs.count()
    kept = quality.quality(docs, labels, only=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.selected for r in out)


def late_labels(spark):
    """Documents, labels, and held-out ids: of more low documents than a sample of 1,500 by hash takes, those
    that it leaves out are low in a way of their own. Odd held-out documents are low in that way."""
    rng = random.Random(8)
    order = [r.id for r in spark.range(1800).orderBy(F.xxhash64("id"), "id").collect()]
    style = lambda t, i: t.upper().replace(" ", "!! ") if i in early else t.replace(" ", " qqq ")
    early = set(order[:1500])
    docs = [(i, style(text(rng, 12), i)) for i in order] + [(i, text(rng, 12)) for i in range(10_000, 11_800)]
    held = [(20_000 + i, style(text(rng, 12), None) if i % 2 else text(rng, 12)) for i in range(100)]
    labels = [(i, int(i >= 10_000), 0) for i, _ in docs]
    return spark.createDataFrame(docs + held, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [i for i, _ in held]


def test_quality_is_fitted_on_all_labels(spark):
    docs, labels, held = late_labels(spark)
    out = {r.doc_id: r.selected for r in quality.quality(docs, labels).collect()}
    assert sum(out[i] == (i % 2 == 0) for i in held) >= 97


@pytest.mark.parametrize("grades", [(0, 1, 2), (0, 2), (0, 1)])
def test_fit_of_all_rows(spark, monkeypatch, grades):
    """The model is at the optimum of the loss over every row, computed here by one process; each labelled id
    is a row once, and grades without rows do no harm."""
    monkeypatch.setattr(ordinal, "HELD", 100)
    monkeypatch.setattr(ordinal, "ENOUGH", 1e-9)
    rng = np.random.default_rng(3)
    x = np.abs(rng.standard_normal((400, 5))).astype(np.float32) * (rng.random((400, 5)) < 0.7)
    grade = np.array(grades)[np.digitize(x @ [2, -1, 0.5, 0, 0] + 0.5 * rng.standard_normal(400), [0, 1.5][: len(grades) - 1])]
    docs = [(i, str(i)) for i in range(400)]
    frame = spark.createDataFrame(docs + docs[:50] + [(999, "0"), (None, "0")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(grade)] + [(998, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    blocks = ordinal.feature_blocks(ordinal.labelled(frame, labels, F.col("quality")).repartition(3), lambda t: x[int(t)])
    assert {r.grade: r.n for r in blocks.groupBy("grade").agg(F.sum("n").alias("n")).collect()} == {g: int((grade == g).sum()) for g in grades} and blocks.count() > 5
    w, theta = ordinal.fit_all(blocks, 5, 3)
    weight = (1.0 / np.maximum(np.bincount(grade), 1) / len(grades))[grade]

    def loss(w, theta):
        upper, lower = (ordinal.sigmoid(np.concatenate([[-np.inf], theta, [np.inf]])[grade + k] - x @ w) for k in (1, 0))
        return -(weight * np.log(np.maximum(upper - lower, 1e-9))).sum() + 0.5e-4 * (w @ w)

    best = loss(w, theta)
    assert theta[0] < theta[1] and w[0] > 0 > w[1]
    for k in range(5):
        for d in (-0.05, 0.05):
            assert loss(w + d * (np.arange(5) == k), theta) > best
    assert all(loss(w, theta + d) > best for d in (-0.05, 0.05))
    if len(grades) == 3:
        assert all(loss(w, theta + np.array([0, d])) > best for d in (-0.05, 0.05))


@pytest.mark.parametrize("fit,column,flag", [(toxicity.toxicity, "severity", "toxic"), (quality.quality, "grade", "selected")])
def test_empty_tables_and_clashing_columns(spark, corpus, fit, column, flag):
    docs, labels, _ = corpus
    none = spark.createDataFrame([], docs.schema)
    assert fit(none, labels).collect() == []
    clash = docs.limit(3).withColumnRenamed("doc_id", "doc_id").selectExpr("doc_id", "text", f"'x' AS {column}", f"1 AS {flag}", "named_struct('a', 1) AS extra")
    out = fit(clash, labels.limit(0))
    assert out.columns.count(column) == 1 and {r[flag] for r in out.collect()} == {flag == "selected"}
