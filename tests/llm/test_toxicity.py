from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import toxicity
from corvane.llm.toxicity import OrdinalModel, fit, score, sparse_features, train
from corvane.llm.wordhash import mix, words
from tests.llm.conftest import prose

BAD = ["grum", "flosk", "vreck", "dworp", "snarg"]


def corpus(seed: int, n: int) -> list[tuple[int, str, int]]:
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w, toxic = prose(seed * 10_000 + i, r.randint(15, 60)).split(), int(r.random() < 0.25)
        for _ in range(r.randint(2, 8) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", ",", "ish", "."]))
        rows.append((i, " ".join(w), toxic))
    return rows


def test_held_out_accuracy_and_order(spark: SparkSession) -> None:
    known, new = corpus(1, 400), corpus(2, 200)
    docs = spark.createDataFrame([r[:2] for r in known], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in known], "doc_id long, toxic int")
    model = train(docs, labels, "toxic")
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in score(spark.createDataFrame([r[:2] for r in new], "doc_id long, text string"), model).collect()}
    wrong = sum(got[i]["toxic"] != bool(t) for i, _, t in new)
    assert wrong <= 4
    one, many = f"{prose(7, 30)} grum", f"{prose(7, 30)} grum flosk vreck dworp snarg grum flosk vreck"
    r = {x["doc_id"]: x["expected_severity"] for x in score(spark.createDataFrame([(1, one), (2, many), (3, prose(7, 30))], "doc_id long, text string"), model).collect()}
    assert r[3] < r[1] < r[2] <= 3.0


def test_scores_against_brute_force(spark: SparkSession) -> None:
    rows = corpus(4, 150)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t, int(i % 3 > 0)) for i, _, t in rows], "doc_id long, toxic int, quality int")
    model = train(docs, labels, toxicity.severity(F.col("toxic"), F.col("quality")))
    assert len(model.thresholds) == 2  # grades 0, 1, 2 share the weights
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    place = lambda b: int(words([b.decode()])[0][0] >> np.uint64(64 - toxicity.FEATURE_BITS))
    stem = lambda b, k: int(mix(words([b[:k].decode()])[0], 17)[0] >> np.uint64(64 - toxicity.FEATURE_BITS))
    for got in score(docs, model).collect():
        count: Counter[int] = Counter()
        for w in re.findall(r"[^\s!-/:-@\[-`{-~]+", rows[got["doc_id"]][1]):
            b = w.encode()
            count.update([place(b), *[stem(b, k) for k in toxicity.STEM_BYTES if len(b) > k]])
        s = sum(np.log1p(n) * weight.get(f, 0.0) for f, n in count.items())
        above = [1 / (1 + np.exp(t - s)) for t in model.thresholds]
        assert np.isclose(got["expected_severity"], sum(above), atol=1e-9)
        assert got["severity_grade"] == sum(x >= 0.5 for x in above) and got["toxic"] == (above[0] >= 0.5)


def test_rows_that_share_an_identifier_are_one_labelled_document(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, "b"), (1, "a a"), (1, "a a"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    got = toxicity._labelled_features(docs, labels, "doc_id", "text", F.col("toxic")).collect()
    assert sorted((r["grade"], len(r["features"])) for r in got) == [(0, 1), (1, 1)]
    assert sorted(r["amounts"][0] for r in got) == [np.log1p(1), np.log1p(2)]


def test_cumulative_links_recover_ordered_grades() -> None:
    r = np.random.default_rng(0)
    x = r.normal(size=3000)
    u = r.logistic(size=3000) + 2 * x
    y = (u > -1).astype(int) + (u > 1) + (u > 3)
    model = fit(pd.DataFrame({"grade": y, "features": [np.array([0])] * len(y), "amounts": [np.array([v]) for v in x]}), np.array([5]), 4)
    assert np.allclose(model.weights, [2], atol=0.2)
    assert np.allclose(model.thresholds, [-1, 1, 3], atol=0.25)
    assert np.isclose(model.expected(np.array([100.0]))[0], 3) and np.isclose(model.expected(np.array([-100.0]))[0], 0)


def test_awkward_rows_and_no_labels(awkward: DataFrame, nothing: DataFrame, spark: SparkSession) -> None:
    none = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = train(awkward, none, "toxic")
    got = score(awkward, model)
    assert got.columns == ["doc_id", "expected_severity", "severity_grade", "toxic"]
    assert got.count() == awkward.count() and got.where("toxic or expected_severity > 1e-6").count() == 0
    assert score(nothing, model).collect() == []
    some = OrdinalModel(np.array([3]), np.array([1.0]), np.array([0.0, 1.0]))
    assert score(awkward, some).count() == awkward.count()


def test_wanted_features_are_the_same_ones() -> None:
    texts = [t for _, t, _ in corpus(3, 20)] + [None, ""]
    rows, feats, values = sparse_features(texts)
    wanted = np.zeros(1 << toxicity.FEATURE_BITS, dtype=bool)
    wanted[feats[::3]] = True
    keep = wanted[feats]
    for a, b in zip(sparse_features(texts, wanted), (rows[keep], feats[keep], values[keep]), strict=True):
        assert np.array_equal(a, b)


def test_grades_of_documents_that_the_model_has_not_seen(spark: SparkSession) -> None:
    r = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        grade = (i % 6 == 0) + (i % 12 == 0)
        words_ = [f"w{r.randint(0, 80)}" for _ in range(40)] + ["nasty"] * (3 * (grade > 0)) + ["vicious"] * (4 * (grade > 1))
        r.shuffle(words_)
        rows.append((i, " ".join(words_)))
        labels.append((i, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (5, None), (None, 1), (9999, 1)], "doc_id long, grade int")
    got = {(x["grade"], x["predicted"]): x["n"] for x in toxicity.cross_validated(docs, known, "grade").collect()}
    assert sum(got.values()) == 600 and got[0, 0] >= 495 and got[1, 1] >= 40 and got[2, 2] >= 40
    assert toxicity.cross_validated(docs, known.limit(0), "grade").count() == 0
