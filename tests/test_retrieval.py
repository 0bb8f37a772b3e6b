"""Retrieval, fusion and re-ranking on literal cases."""

from __future__ import annotations

import math
import re
from itertools import chain

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import dense, fusion, rerank, sparse

CHUNKS = [
    ("k1", "The harbour crane lifts steel boxes while a second harbour crane waits."), ("k2", "A steel hull needs paint each spring."), ("k3", "Gulls rest on the pier at noon."),
    ("k4", "Each spring the pier is closed, and the crane stands still."), ("k5", "Nobody paints the gulls."),
]


def okapi(query: str) -> list[tuple[str, float]]:
    """The public formula, written out: k1 = 1.5, b = 0.75, negative idf replaced by a quarter of the mean."""
    split = lambda t: re.findall(r"[a-z0-9_]+", t.lower())
    texts = {i: split(t) for i, t in CHUNKS}
    mean = sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in t for t in texts.values()) for w in set(chain.from_iterable(texts.values()))}
    raw = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    score = {i: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in split(query)) for i, t in texts.items()}
    return sorted(((i, round(x, 6)) for i, x in score.items()), key=lambda r: (-r[1], r[0]))


def bm25(spark: SparkSession, query: str, k: int) -> list[tuple[str, float]]:
    docs = spark.createDataFrame(CHUNKS, "doc_id string, text string")
    terms = sparse.query_terms(spark.createDataFrame([("q", query)], "query_id string, query string"))
    rows = sparse.search(sparse.bm25_scores(docs, terms), docs, terms, k).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["doc_id"], round(r["score"], 6)) for r in rows]


def test_bm25(spark: SparkSession) -> None:
    assert bm25(spark, "harbour crane", 10)[0][0] == "k1"
    for q in ("crane spring crane pier", "the gulls", "The the steel", "paint paints"):
        assert bm25(spark, q, 10) == okapi(q)
    assert bm25(spark, "submarine", 10) == [(f"k{i}", 0.0) for i in range(1, 6)]
    for q in ("", "   ", "???!!!"):
        assert bm25(spark, q, 10) == []
    assert [len(bm25(spark, "crane", k)) for k in (2, 1000, 0, -1)] == [2, 5, 0, 0]


def test_bm25_on_nothing(spark: SparkSession) -> None:
    docs = spark.createDataFrame([], "doc_id string, text string")
    terms = sparse.query_terms(spark.createDataFrame([("q", "a")], "query_id string, query string"))
    assert sparse.search(sparse.bm25_scores(docs, terms), docs, terms, 5).collect() == []


def ranked(spark: SparkSession, *rows: tuple[str, int]) -> DataFrame:
    return spark.createDataFrame([("q", i, f"{i}-text", r) for i, r in rows], "query_id string, doc_id string, text string, rank int")


def fused(lists: list[DataFrame], **kw) -> list[tuple[str, float]]:
    return [(r["doc_id"], round(r["score"], 9)) for r in fusion.rrf(lists, **kw).orderBy("rank").collect()]


def test_rrf(spark: SparkSession) -> None:
    none = ranked(spark)
    assert fused([ranked(spark, ("c1", 1)), ranked(spark, ("c1", 1))]) == [("c1", round(2 / 61, 9))]
    assert fused([ranked(spark, ("c1", 3)), none]) == [("c1", round(1 / 63, 9))]
    assert fused([none, ranked(spark, ("c1", 2))]) == [("c1", round(1 / 62, 9))]
    assert fused([ranked(spark, ("c1", 1)), none], k=10) == [("c1", round(1 / 11, 9))]
    assert [i for i, _ in fused([ranked(spark, ("low", 5), ("high", 1)), none])] == ["high", "low"]
    assert [i for i, _ in fused([ranked(spark, ("z_first", 1)), ranked(spark, ("a_second", 1))])] == ["z_first", "a_second"]
    assert len(fused([ranked(spark, ("c1", 1), ("c2", 2)), ranked(spark, ("c1", 1), ("c3", 1))])) == 3
    assert fused([ranked(spark, ("c1", 1)), none], top_k=0) == fused([none, none]) == []
    other = ranked(spark, ("c1", 1)).withColumn("text", F.lit("other"))
    assert fusion.rrf([ranked(spark, ("c1", 2)), other]).first()["text"] == "c1-text"


def test_overlap_and_results(spark: SparkSession) -> None:
    a, b = ranked(spark, ("x", 1), ("y", 2)), ranked(spark, ("y", 1), ("z", 2))
    assert fusion.overlap(a, b).collect()[0]["overlap"] == 1
    some = b.withColumn("query_id", F.lit("p"))
    assert {(r["query_id"], r["doc_id"]) for r in fusion.results(a.unionByName(some), b.limit(1), 1).collect()} == {("q", "y"), ("p", "y")}


def test_dense(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [3.0, 0.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("n", None)], "query_id string, embedding array<double>")
    rows = dense.cosine_top_k(docs, asked, 3).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in rows] == [(1, 1.0), (5, 1.0), (3, 0.707107)]
    assert dense.cosine_top_k(docs, asked, 0).collect() == [] and dense.cosine_top_k(docs, asked.limit(0), 5).collect() == []
    assert dense.centroid(docs).first()["centroid"] == [1.25, 0.75]


def test_dense_parts_change_nothing(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Queries in parts of one or a few vectors give the lists of one part, ties and a query without an identifier included."""
    docs = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(60)], "doc_id long, embedding array<double>")
    rows = [(None if i == 4 else i, [float(i % 3), float(-i), 2.0]) for i in range(20)]
    asked = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    found = [tuple(sorted(map(str, dense.cosine_top_k(docs, asked, 4).collect())))]
    for size in (24, 100):
        monkeypatch.setattr(dense, "QUERY_BYTES", size)
        found.append(tuple(sorted(map(str, dense.cosine_top_k(docs, asked, 4).collect()))))
    assert len(found[0]) == 80 and len(set(found)) == 1


def test_rerank(spark: SparkSession) -> None:
    pool = spark.createDataFrame([("q", "a b", f"c{i}", t, 9.0 - i, i) for i, t in ((1, "x"), (2, "a"), (3, "a b"))], "query_id string, query string, doc_id string, text string, score double, rank int")

    def ids(df: DataFrame) -> list[str]:
        return [r["doc_id"] for r in df.orderBy("rank").collect()]

    assert ids(rerank.by_score(pool, rerank.lexical_overlap(F.col("query"), F.col("text")), 2)) == ["c3", "c2"]
    assert ids(rerank.fallback(pool, 2)) == ["c1", "c2"] and ids(rerank.fallback(pool, 0)) == []
    fails = lambda q, t: F.when(t == "a", None).otherwise(1.0)
    got = rerank.routed(pool, "live_frontier", {"live_frontier": fails, "live_fast": rerank.lexical_overlap}, 3)
    assert ids(got) == ["c3", "c2", "c1"] and {r["tier"] for r in got.collect()} == {"live_fast"}
    got = rerank.routed(pool, "live_quality", {"live_quality": fails}, 3)
    assert ids(got) == ["c1", "c2", "c3"] and {r["tier"] for r in got.collect()} == {"fallback"} and got.orderBy("rank").first()["score"] == 8.0
    with pytest.raises(ValueError, match="unknown mode"):
        rerank.routed(pool, "nonsense", {}, 3)
    with pytest.raises(NotImplementedError):
        rerank.routed(pool, "benchmark", {}, 3)
    assert rerank.resolve_mode("fallback") == "fallback" and rerank.resolve_mode() == "live_fast"
