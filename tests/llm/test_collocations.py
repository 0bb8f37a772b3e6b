"""Collocations against brute force over all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

from corvane.llm import collocations as co

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: str | None) -> list[list[str]]:
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD))]


def brute(rows: list[tuple], least: int = 10, top: int = 2000) -> list[tuple]:
    out = []
    for lang in sorted({r[0] or "und" for r in rows}):
        f: Counter = Counter()
        for own, text in rows:
            if (own or "und") == lang:
                for p in pieces(text):
                    f.update(tuple(p[i : i + k]) for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(c for w, c in f.items() if len(w) == 1)
        found = []
        for w, a in f.items():
            if len(w) == 1 or a < least:
                continue
            if any(100 * c >= 50 * a for x, c in f.items() if len(x) > len(w) and c >= least and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))):
                continue
            score, k = min((1000000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed: int, n: int, words: int = 25) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["New", "york", "x\x01", "é", "É", "a", "b", "\x00z", "日本", *[f"w{i}" for i in range(words)]]
    ends = [" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n"]
    return [(r.choice(["en", "de", None]), "".join(r.choice(vocabulary[: r.choice([4, 9, 99])]) + r.choice(ends) for _ in range(r.randint(0, 120)))) for _ in range(n)]


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_brute_force(spark: SparkSession) -> None:
    rows = [*texts(1, 150), ("en", None), ("und", "a b a b"), (None, ""), ("en", "one two " * 40)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert rows_of(co.collocations(df)) == brute(rows)
    assert rows_of(co.collocations(df, top=7)) == brute(rows, top=7)


def test_other_columns_and_no_rows(spark: SparkSession, awkward: DataFrame, nothing: DataFrame) -> None:
    got = rows_of(co.collocations(awkward, least=1, top=50))
    assert got == brute([(r["lang"], r["text"]) for r in awkward.collect()], least=1, top=50)
    assert co.collocations(nothing).count() == 0


def test_merges_that_find_nothing(spark: SparkSession) -> None:
    """Prefix partitions and languages in which no phrase is frequent, alone and beside others that have some."""
    rare = [("en", " ".join(f"only{i}x{j}" for j in range(9))) for i in range(6)] + [("de", "once seen")]
    assert rows_of(co.collocations(spark.createDataFrame(rare, "lang string, text string"))) == []
    rows = [*rare, *[("fr", f"deux mots u{i}") for i in range(12)]]
    got = rows_of(co.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3)))
    assert got == brute(rows) and len(got) == 1


def test_large_counts_stay_exact(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(3_000_000_000, 5_000_000_011, 4_999_999_999)], "a long, l long, r long")
    w = lambda c: f"cast({c} as decimal(15, 0))"
    got = rows.selectExpr(f"cast(1000000 as decimal(7, 0)) * ({w('a')} * {w('a')}) div ({w('l')} * {w('r')}) as s").first()["s"]
    assert got == 1000000 * 3_000_000_000**2 // (5_000_000_011 * 4_999_999_999)


def test_trie_bursts_and_spills_whole_containers() -> None:
    r = np.random.default_rng(2)
    trie, want = co.HatTrie(burst=8), Counter()
    out: Counter = Counter()
    for _ in range(30):
        w = r.integers(1, [3, 4, 60], size=(200, 3))
        paths = (w[:, 0] << 2 * co.BITS) | (w[:, 1] << co.BITS) | w[:, 2]
        trie.add(paths)
        want.update(paths.tolist())
        assert all(len(t) <= 8 for t in trie.held) and trie.begins == sorted(set(trie.begins))
        if trie.size > 150:
            keys, counts = trie.spill(60)
            assert trie.size <= 60 and (np.diff(keys) > 0).all()
            out.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    keys, counts = trie.spill(0)
    out.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert out == want and trie.size == 0


@pytest.mark.parametrize(("batch", "held", "vocabulary", "block", "merged"), [(3, 10, 12, 2, 3), (50, 40, 1 << 19, 5, 20), (7, 1 << 20, 9, 100, 1)])
def test_runs_merge_to_the_same_counts(monkeypatch: pytest.MonkeyPatch, batch: int, held: int, vocabulary: int, block: int, merged: int) -> None:
    for k, v in {"BATCH": batch, "HELD": held, "VOCABULARY": vocabulary, "BLOCK": block, "MERGED": merged}.items():
        monkeypatch.setattr(co, k, v)
    rows = [t for _, t in texts(5, 40, words=12)]
    want: Counter = Counter()
    blocks = []
    for half in (rows[:20], rows[20:]):  # two tasks
        c = co._Counter("en", buckets=3)
        for t in half:
            blocks += [x for df in c.add(t) for x in df.itertuples(index=False)]
            for p in pieces(t):
                want.update(" ".join(p[i : i + k]) for k in (1, 2, 3) for i in range(len(p) - k + 1))
        blocks += [x for df in c.close() for x in df.itertuples(index=False)]
    got: dict[str, int] = {}
    for bucket in range(3):
        own = sorted((b for b in blocks if b.bucket == bucket and b.nodes is not None), key=lambda b: (b.first, b.second))
        open_, waiting = [], 0
        for b in own:
            if waiting >= merged:
                open_, found = co._merged(open_, (b.first, b.second), 2)
                got.update({p.decode(): f for p, f in found})
                waiting = 0
            open_.append(co._Block(b))
            waiting += len(open_[-1].nodes)
        got.update({p.decode(): f for p, f in co._merged(open_, None, 2)[1]})
    assert got == {p: f for p, f in want.items() if f >= 2}
    assert sum(int(b.n) for b in blocks if b.nodes is None) == sum(f for p, f in want.items() if " " not in p)
