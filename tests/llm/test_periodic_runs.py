"""Runs against brute force over all starts and periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.periodic_runs import _surviving, periodic_runs, runs_of


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id: int | None, text: str | None) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def sequences(seed: int, n: int) -> list[list[int]]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w: list[int] = []
        while len(w) < r.randint(0, 160):
            kind = r.random()
            if kind < 0.4:
                unit = [r.randint(0, r.choice([1, 2, 5, 40])) for _ in range(r.randint(1, 9))]
                w += (unit * r.randint(1, 9))[: r.randint(1, 60)]
            elif kind < 0.6 and w:
                w += w[-r.randint(1, len(w)) :] * r.randint(1, 3)
            else:
                w += [r.randint(0, r.choice([1, 3, 300])) for _ in range(r.randint(1, 12))]
        out.append(w[:400])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_sequences(seed: int) -> None:
    texts = sequences(seed, 120)
    got = runs_of([np.array(t, dtype=np.int64) for t in texts])
    assert got == [brute_runs(t) for t in texts]
    assert sum(map(len, got)) > 50


def test_nested_and_very_long_runs() -> None:
    nested = [*([1] * 7 + [2, 3]) * 9, 4, *([5, 6] * 5)]
    same = [0] * 200_000
    got = runs_of([np.array(t, dtype=np.int64) for t in (nested, same, list(range(50_000)) * 4, [])])
    assert got[0] == brute_runs(nested) and len(got[0]) == 11
    assert got[1:] == [[(0, 200_000, 1)], [(0, 200_000, 50_000)], []]


def test_splitting_leaves_only_what_can_repeat() -> None:
    words = np.array([1, 2, 1, 2, 1, 2, 1, 2, 9, *range(20, 60), 3, 3, 3, 3, 3, 3])
    assert _surviving(words, np.zeros(len(words), dtype=np.int64)).tolist() == [*range(8), *range(49, 55)]
    assert _surviving(words[:0], words[:0]).tolist() == []


def test_rows_against_brute_force(spark: SparkSession, awkward: DataFrame, nothing: DataFrame) -> None:
    rows = [(i, " ".join(f"w{x}" for x in t)) for i, t in enumerate(sequences(11, 200))] + [(r["doc_id"], r["text"]) for r in awkward.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in periodic_runs(df, plant=True).select(*COLUMNS).collect()), key=str)
    assert got == sorted((brute_row(*r) for r in rows), key=str)
    assert periodic_runs(nothing).count() == 0
    plain = periodic_runs(awkward).select("doc_id", "text_out", "n_runs").collect()
    assert len(plain) == awkward.count() and all(r["n_runs"] == 0 for r in plain)
    words = {(r["doc_id"], " ".join(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in awkward.collect()}
    assert {(r["doc_id"], r["text_out"]) for r in plain} == words
