"""Compares a DataFrame with DuckDB SQL over the same tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def plain(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def compare(df: DataFrame, sql: str, folder: str) -> None:
    """Equal columns (in any order) and equal rows (in any order, numbers to six places)."""
    con = duckdb.connect()
    for t in os.listdir(folder):
        path = f"{folder}/{t}" + ("/*.parquet" if (Path(folder) / t).is_dir() else "")
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall()), key=str)
    have = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), (a, b)
