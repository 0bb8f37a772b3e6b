from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.mixing import fit_steps, label_domain, mix, rate_of, train_classifier
from tests.llm.conftest import prose

DOMAINS = ["a", "b", "c"]


def members(spark: SparkSession, n: int = 300) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    r = np.random.default_rng(3)
    p = r.dirichlet([0.3, 0.3, 0.3], n)
    t = r.integers(0, 500, n)
    df = spark.createDataFrame([(i, int(t[i]), [float(x) for x in p[i]]) for i in range(n)], "doc_id long, tokens long, p array<double>")
    return df, t, p


def brute(t: np.ndarray, p: np.ndarray, target: np.ndarray, cap: float | None) -> np.ndarray:
    """The same iteration on arrays, to the end."""
    rate, present = np.ones(len(t)), t @ p
    for _ in range(5000):
        off = (rate * t @ p - target) / present
        rate = np.clip(rate - p @ off, 0, cap)
    return rate


@pytest.mark.parametrize("cap", [None, 1.0])
def test_rates_meet_targets_like_brute_force(spark: SparkSession, cap: float | None) -> None:
    df, t, p = members(spark)
    weights = {"a": 0.2, "b": 0.3, "c": 0.5}
    steps = fit_steps(df, DOMAINS, weights, max_rate=cap, rounds=80, close=1e-6)
    got = {r["doc_id"]: r["rate"] for r in df.withColumn("rate", rate_of(F.col("p"), steps, cap)).collect()}
    rate = np.array([got[i] for i in range(len(t))])
    target = t.sum() * np.array([0.2, 0.3, 0.5])
    assert (rate >= 0).all() and (cap is None or rate.max() <= cap)
    best = brute(t, p, target, cap)
    loss = lambda r: (((r * t) @ p - target) ** 2 / (t @ p)).sum()
    assert loss(rate) <= (1.02 if cap is None else 1.2) * loss(best) + 1e-3
    if cap is None:
        assert np.allclose(rate * t @ p, target, rtol=1e-3)


def test_unreachable_domains_and_empty_tables(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "doc_id long, tokens long, p array<double>")
    steps = fit_steps(df, ["a", "b"], {"a": 0.5, "b": 0.5})
    rows = {r["doc_id"]: r["rate"] for r in df.withColumn("rate", rate_of(F.col("p"), steps)).collect()}
    assert rows[1] == pytest.approx(0.5, rel=1e-2)
    assert len(fit_steps(df.limit(0), ["a", "b"], {"a": 1.0})) <= 1


def labelled(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    r = random.Random(1)
    docs, labels = [], []
    for i in range(300):
        w = prose(i, 40).split()
        kind = i % 3
        if kind == 1:
            w = [x + "###" for x in w]
        if kind == 2:
            for _ in range(4):
                w.insert(r.randrange(40), r.choice(["grum", "flosk"]))
        docs.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_posteriors_and_mix(spark: SparkSession) -> None:
    docs, labels = labelled(spark)
    out, domains = mix(docs, labels, label_domain(), {"clean": 0.8, "rough": 0.1, "toxic": 0.1})
    assert domains == ["clean", "rough", "toxic"]
    rows = out.collect()
    assert len(rows) == 300 and all(abs(sum(r["p"]) - 1) < 1e-9 for r in rows)
    assert sum(np.argmax(r["p"]) == [0, 1, 2][r["doc_id"] % 3] for r in rows) >= 270
    total = sum(r["tokens"] for r in rows)
    got = np.sum([np.array(r["p"]) * r["rate"] * r["tokens"] for r in rows], axis=0)
    assert np.allclose(got, np.array([0.8, 0.1, 0.1]) * total, rtol=5e-3)
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in rows)


def test_awkward_rows(awkward: DataFrame, nothing: DataFrame, spark: SparkSession) -> None:
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 1), (None, 1, 1), (7, None, None), (12, 0, 0)], "doc_id long, quality int, toxic int")
    out, _ = mix(awkward, labels, label_domain(), {"clean": 1.0})
    assert out.count() == awkward.count() and out.where("rate < 0 or rate is null or tokens is null").count() == 0
    assert mix(nothing, labels, label_domain(), {"clean": 1.0})[0].collect() == []
    model = train_classifier(awkward, labels.limit(0), label_domain())
    assert model.domains == ["all"]
    assert awkward.select(model.posteriors(F.col("text")).alias("m")).where("m.p[0] <> 1").count() == 0


def test_tokens_are_words_between_marks_and_white_space(spark: SparkSession) -> None:
    texts = ["...", "hello world.", " ,a;b: c!? ", "", "a\x0bb\rc", "\u00a0x", "no-mark", "One, two... three?"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    mixed, _ = mix(df, labels, label_domain(), {"clean": 0.5, "rough": 0.5})
    want = {i: len([w for w in re.split(r"[\x20\x09-\x0D.,!?;:]+", t) if w]) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["tokens"] for r in mixed.collect()} == want == {0: 0, 1: 2, 2: 3, 3: 0, 4: 3, 5: 1, 6: 1, 7: 3}
