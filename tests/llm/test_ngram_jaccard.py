"""The join against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import ngram_jaccard
from corvane.llm.ngram_jaccard import components, jaccard_components
from corvane.llm.wordhash import shingles, words
from corvane.sources import store
from tests.llm.conftest import awkward_rows, prose


def shingle_set(text: str | None, size: int) -> frozenset:
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def brute(rows: list[tuple], size: int, num: int) -> list[tuple]:
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def got(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_awkward_rows(awkward: DataFrame, size: int, num: int) -> None:
    want = brute([r[:2] for r in awkward_rows()], size, num)
    assert got(jaccard_components(awkward, size=size, num=num)) == want


def test_chains_groups_and_shared_passages(spark: SparkSession) -> None:
    r = random.Random(5)
    passage, rows = prose(99, 40), []
    for g in range(6):
        w = prose(g, 150).split()
        for k in range(r.choice([1, 3, 25])):
            v = list(w)
            for _ in range(r.randint(0, 4)):
                v[r.randrange(len(v))] = f"x{r.randrange(50)}"
            rows.append((len(rows) * 7 % 1009, " ".join(v) + (" " + passage if g % 2 else "")))
            w = v if g == 5 else w  # the last group is a chain
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, num in ((3, 90), (5, 80)):
        assert got(jaccard_components(df, size=size, num=num)) == brute(rows, size, num)


@pytest.mark.parametrize(("sets", "shingles_held"), [(1, 10**9), (7, 10**9), (128, 400)])
def test_blocks_change_nothing(spark: SparkSession, sets: int, shingles_held: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", sets)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SHINGLES", shingles_held)
    monkeypatch.setattr(ngram_jaccard, "WIDTH", 64)
    r, base, rows = random.Random(8), prose(3, 140).split(), []
    for i in range(60):
        v = list(base)
        for _ in range(r.randint(1, 6)):
            v[r.randrange(len(v))] = f"y{i % 20}"
        rows.append((i, " ".join(v)))
    assert got(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 3, 90)


def test_hot_shingles_change_nothing(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = [(i, f"{prose(i // 2, 30)} {prose(99, 60)} {'w' + str(i) if i % 2 else ''}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_jaccard._hot(df.select(F.array(F.lit(5).cast("long"), F.col("doc_id")).alias("x")), "x") == [5]
    monkeypatch.setattr(ngram_jaccard, "_hot", lambda lists, column: [r["h"] for r in lists.select(F.explode(column).alias("h")).groupBy("h").count().where("count > 10").collect()])
    assert got(jaccard_components(df)) == brute(rows, 3, 90)


def test_empty(nothing: DataFrame) -> None:
    assert jaccard_components(nothing).collect() == []


def test_components_of_a_path(spark: SparkSession) -> None:
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(df).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("per_file", [100_000, 20])
def test_components_of_hubs_and_hot_keys(spark: SparkSession, per_file: int, monkeypatch: pytest.MonkeyPatch) -> None:
    """Stars around low, middle and high nodes, joined by a chain: hubs and roots are hot keys, tasks hold few links."""
    monkeypatch.setattr(ngram_jaccard, "ROWS_PER_FILE", per_file)
    monkeypatch.setattr(ngram_jaccard, "HOT_ROWS", 10)
    stars = [(hub, hub + i) for hub in (1000, 3000) for i in range(1, 150)] + [(5000 - i, 5000) for i in range(1, 150)]
    chain = [(1001, 2000), (2000, 2001), (2001, 3007), (9001, 9000)]
    df = spark.createDataFrame(stars + chain, "a long, b long")
    nodes = {x for e in stars + chain for x in e}
    want = {x: 9000 if x >= 9000 else min(y for y in nodes if y > 4000) if x > 4000 else 1000 for x in nodes}
    assert {r["node"]: r["root"] for r in components(df).collect()} == want


def test_hot_keys_change_nothing(spark: SparkSession, awkward: DataFrame, monkeypatch: pytest.MonkeyPatch) -> None:
    """Every key that two rows share is hot: shingles, hubs, roots, groups of copies; empty texts have no key."""
    monkeypatch.setattr(ngram_jaccard, "ROWS_PER_FILE", 20)
    monkeypatch.setattr(ngram_jaccard, "HOT_ROWS", 1)
    rows = [(3 * i, f"{prose(i // 9, 60)} {'w' + str(i) if i % 3 else ''}" if i % 5 else None) for i in range(90)]
    assert got(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 3, 90)
    cold = got(jaccard_components(awkward))
    monkeypatch.setattr(ngram_jaccard, "HOT_ROWS", 10**6)
    assert got(jaccard_components(awkward)) == cold


def test_word_digests_tell_words_apart_as_python_does() -> None:
    texts = [t for _, t, *_ in awkward_rows()]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)) for t in texts]
    digest, owner = words(texts)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(zip(flat, digest.tolist(), strict=True))) == len(set(flat)) == len(set(digest.tolist()))
    assert [len(s) for s in shingles(texts, 3)] == [len(shingle_set(t, 3)) for t in texts]


def test_long_words_of_two_letters_keep_their_own_digests(spark: SparkSession) -> None:
    """Thue-Morse words and their complements: no sum of letters times powers of a number modulo 2**64 tells them apart."""
    a, b, pairs = "a", "b", []
    for _ in range(14):
        a, b = a + b, b + a
        pairs.append((a, b))
    digests = words([x for p in pairs for x in p])[0].tolist()
    assert len(set(digests)) == 2 * len(pairs)
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)


def test_nothing_that_grows_is_broadcast(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Spark would broadcast tables of these sizes, and does so by their pressed files' size; no stored table comes from such a join when survivors are over their limit."""
    joins: dict[str, set[str]] = {}

    def kept(df: DataFrame, name: str) -> DataFrame:
        joins.setdefault(name, set()).update(re.findall(r"BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin", df._jdf.queryExecution().executedPlan().toString()))
        return store.stored(df, name)

    monkeypatch.setattr(ngram_jaccard, "stored", kept)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", 2)
    rows = [(10 * i + j, prose(i, 30) + f" end{j}") for i in range(8) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(docs)) == brute(rows, 3, 90)
    assert not [name for name, kinds in joins.items() if "BroadcastHashJoin" in kinds]
    assert "ShuffledHashJoin" in joins["sets"] and "SortMergeJoin" in joins["labels"] and "SortMergeJoin" in joins["setblocks"]
