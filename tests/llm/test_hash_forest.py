"""The forest against comparison with all vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import hash_forest as hf


def brute(rows: list[tuple], every: int, k: int) -> dict[int, list[tuple[int, float]]]:
    """The k nearest of each query, with cosines."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=float)
    out = {}
    for q, x in good.items():
        if q % every == 0:
            near = [(-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in good.items() if i != q and len(y) == len(x)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def got(df: DataFrame) -> dict[int, list[tuple[int, float]]]:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(seed: int, n: int, dim: int) -> list[tuple]:
    """Random directions, a tight group that holds a third of all, looser groups and equal vectors."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x[: n // 3] = x[0] + 0.02 * r.standard_normal((n // 3, dim))
    x[n // 3 : n // 2] = x[n // 3 + r.integers(0, 8, n // 2 - n // 3)] + 0.3 * r.standard_normal((n // 2 - n // 3, dim))
    x[-n // 10 :] = x[-1]
    at = r.permutation(n)
    return [(int(i), x[j].astype(np.float32).tolist()) for i, j in enumerate(at)]


SCHEMA = "vec_id long, embedding array<float>"


def test_small_and_awkward_tables_are_exact(spark: SparkSession) -> None:
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (2, [2.0, 0.0]), (4, [1.0, 0.0]), (6, [0.0, 1.0]), (8, [-1.0, 0.5]), (10, None), (12, [0.0, 0.0]), (14, [nan, 1.0]), (16, [inf, 1.0]), (18, [None, 1.0]), (20, []),
        (None, [1.0, 0.0]), (22, [1.0, 2.0, 3.0]), (24, [3.0, 2.0, 1.0]), (26, [1e-30, 1e-30]), (28, [1e30, 1e30]), (-2, [0.25, -0.0]), (1, [0.5, 0.5]), (0, [1.0, 0.0]), (30, [1.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"label": F.lit(1), "q": F.lit("clash"), "p": F.lit(2), "v": F.lit(None)})
    want = brute([(i, v) for i, v in rows], 2, 3)
    have = got(hf.nearest(df, F.col("vec_id") % 2 == 0, k=3))
    assert set(have) == {q for q, x in want.items() if x} and have.keys() >= {0, 22, 28}
    for q, found in have.items():
        assert [s for _, s in found] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    assert [i for i, _ in have[0]][:2] == [2, 4][: len(have[0])] or {i for i, _ in have[0]} <= {-2, 2, 4}
    assert have[0][0][0] == -2 and have[22] == [(24, pytest.approx(10 / 14))]
    assert hf.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).count() == 0


def test_recall_and_scores(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = vectors(3, 3000, 24)
    want = brute(rows, 20, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    monkeypatch.setattr(hf, "SAMPLE_QUERIES", 60)
    have = got(hf.nearest(df, F.col("vec_id") % 20 == 0))
    assert set(have) == set(want) and all(len(x) == 5 for x in have.values())
    by_id = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    hits = 0
    for q, found in have.items():
        least = want[q][-1][1]
        hits += sum(s >= least - 1e-12 for _, s in found)
        for i, s in found:
            x, y = by_id[q], by_id[i]
            assert i != q and s == pytest.approx(float(x @ y / np.sqrt((x @ x) * (y @ y))), abs=1e-14)
        assert found == sorted(found, key=lambda r: (-r[1], r[0]))
    assert hits / (5 * len(want)) >= 0.93
    # what is found follows from the vectors, not from how Spark deals them or how ranges are cut
    monkeypatch.setattr(hf, "RANGE_ROWS", 900)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert got(hf.nearest(df.coalesce(1), F.col("vec_id") % 20 == 0)) == have
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_levels_are_prefixes() -> None:
    x = np.random.default_rng(0).standard_normal((50, 8))
    keys = hf._keys(3, hf._hashes(x, 3), [bytes([i]) * 16 for i in range(50)], 8)
    for level in (0, 1, 2, 30, hf.DEEPEST):
        low, high = (hf._text(y) for y in hf._bounds(keys, level))
        bits = np.unpackbits(keys[:, hf.HEAD : hf.HEAD + 16], axis=1)[:, : hf._bits(level)]
        same = (bits[:, None] == bits[None]).all(axis=2)
        inside = (low[:, None] <= hf._text(keys)[None]) & (hf._text(keys)[None] <= high[:, None])
        assert (same == inside).all()
