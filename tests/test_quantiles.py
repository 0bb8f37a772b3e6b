"""Exact quantiles against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from corvane.operators.quantiles import quantiles

PROBS = [0.0, 0.25, 0.5, 0.95, 1.0]


def test_groups(spark: SparkSession) -> None:
    r = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 997), ("d", 40)) for v in r.integers(0, 50 if k == "c" else 10_000, n)] + [("a", None), ("e", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {x["k"]: x["q"] for x in quantiles(df, "v", PROBS, ("k",)).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile([v for x, v in rows if x == k and v is not None], PROBS).tolist())


def test_whole_and_empty(spark: SparkSession) -> None:
    values = [float(x) for x in np.random.default_rng(2).normal(size=1500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    assert quantiles(df, "v", PROBS).first()["q"] == pytest.approx(np.quantile(values, PROBS).tolist())
    assert [r["q"] for r in quantiles(df.limit(0), "v", PROBS).collect()] == [[]]
    assert quantiles(df.selectExpr("v", "1 as k").limit(0), "v", PROBS, ("k",)).collect() == []
