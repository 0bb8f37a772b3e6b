"""Encoder seams, the retrieval node and what follows it."""

from __future__ import annotations

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import agreement, analytics, encode, flow, fusion, judge
from corvane.plans import runner
from corvane.sources import readers
from corvane.sources.store import shared_dir


def counts(texts: list[str]) -> list[dict[str, float]]:
    """A deterministic encoder: how often each word occurs."""
    assert len(texts) <= encode.BATCH
    return [dict(Counter(t.lower().split())) for t in texts]


def test_sparse_encoder_and_search(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(i, f"red {'blue ' * (i % 3)}w{i}") for i in range(70)] + [(70, " "), (71, None)], "doc_id long, text string")
    asked = spark.createDataFrame([("q1", "blue blue red"), ("q2", "  "), ("q3", "nothing like it")], "query_id string, query string")
    d, q = encode.sparse_vectors(docs, "doc_id", encoder=counts), encode.sparse_vectors(asked, "query_id", "query", counts)
    assert d.where("doc_id >= 70").count() == 0
    got = [(r["query_id"], r["doc_id"], r["score"]) for r in encode.sparse_top_k(d, q, 3).orderBy("query_id", "rank").collect()]
    assert got == [("q1", 2, 5.0), ("q1", 5, 5.0), ("q1", 8, 5.0)]
    assert encode.sparse_top_k(d, q, 0).collect() == []
    with pytest.raises(RuntimeError):
        encode.sparse_top_k(None, q, 3)
    plain = {(r["doc_id"], r["term"]): r["weight"] for r in encode.sparse_vectors(docs, "doc_id").collect()}
    assert plain[2, "blue"] == pytest.approx(1.0986122886681098) and (0, "blue") not in plain


def test_dense_encoder_and_prefixes(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "doc_id long, text string")
    got = {r["doc_id"]: r["embedding"] for r in encode.dense_vectors(rows, "doc_id", lambda texts: [[len(t), 1] for t in texts]).collect()}
    assert got == {1: [2.0, 1.0], 3: [3.0, 1.0]}
    p = rows.where("doc_id = 1").select(encode.prefixed(F.col("text"), "query").alias("q"), encode.prefixed(F.col("text"), "passage").alias("p"), encode.prefixed(F.col("text"), "query", "bge-m3").alias("n")).first()
    assert tuple(p) == ("query: ab", "passage: ab", "ab")
    with pytest.raises(ValueError, match="side"):
        encode.prefixed(F.col("text"), "other")


def ranked(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([("q", i, f"{i} text", 1.0, n) for n, i in enumerate(ids, 1)], "query_id string, doc_id string, text string, score double, rank int")


def ids(df: DataFrame) -> list[str]:
    return [r["doc_id"] for r in df.orderBy("rank").collect()]


def test_retrieval_node(spark: SparkSession) -> None:
    assert ids(flow.retrieve(lambda: ranked(spark, "a", "b"), lambda: ranked(spark, "b", "c")).fused) == ["b", "a", "c"]
    assert ids(flow.retrieve(lambda: ranked(spark, "a", "b"), None).fused) == ["a", "b"]
    broken = lambda: ranked(spark, "a").withColumn("rank", F.raise_error(F.lit("index is gone")).cast("int"))
    state = flow.retrieve(lambda: ranked(spark, "a"), broken)
    assert state.fused is None and "index is gone" in state.error
    assert flow.rerank_with(state, lambda x: x) is state and flow.hand_off(state) == {"error": state.error}
    assert flow.take_over(flow.hand_off(state)).error == state.error


def test_the_whole_chain(spark: SparkSession) -> None:
    state = flow.retrieve(lambda: ranked(spark, "a", "b", "c"), None)
    state = flow.rerank_with(state, lambda x: x.withColumn("rank", (4 - F.col("rank")).cast("long")).where("rank <= 2"))
    assert ids(state.reranked) == ["c", "b"]
    state = flow.take_over(flow.hand_off(state), flow.State(fused=state.fused))
    state = flow.generate_with(state, lambda p: p.groupBy("query_id").agg(F.lit("it is so").alias("claim"), F.concat(F.array_sort(F.collect_list("doc_id")), F.array(F.lit("zz"))).alias("chunk_ids")))
    passages = fusion.results(state.fused, state.reranked, 5).select("query_id", F.col("doc_id").alias("chunk_id"), "text")
    state = flow.evaluate(state, passages, F.col("text").contains("c"))
    assert {(r["chunk_id"], r["supported"]) for r in state.judgments.collect()} == {("b", False), ("c", True), ("zz", False)}
    assert state.accuracy.first()[0] == pytest.approx(1 / 3)
    assert flow.evaluate(flow.State(error="e"), passages, F.lit(True)).judgments is None


def test_small_ones(spark: SparkSession, tmp_path: Path) -> None:
    rows = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.2, 0.4), (3, 0.9, None)], "q long, rbo double, rho double")
    assert tuple(agreement.gap(rows, "rbo", "rho").first()) == (1, 2, pytest.approx(0.1))
    runs = spark.createDataFrame([(1, "a", 2.0), (3, "c", None), (2, "b", 5.0)], "ts long, id string, m double")
    assert analytics.newest(runs, "ts", "m", "id").first()["m"] is None and analytics.newest(runs.where("ts < 3"), "ts", "m", "id").first()["m"] == 5.0
    assert judge.label_pool(rows, F.when(F.col("rho").isNotNull(), (F.col("rho") > 0.2).cast("int"))).count() == 2
    assert tuple(judge.average_scores(rows.select("rbo", "rho")).first()) == (pytest.approx(1.6 / 3), pytest.approx(0.25))
    (tmp_path / "pools.json").write_text(json.dumps([{"query_id": "q1", "method_c_rrf": [{"chunk_id": "c", "text": "t", "score": 0.5, "rank": 1}]}, {"query_id": "q2", "method_c_rrf": []}]))
    assert [tuple(r) for r in readers.cached_pools(spark, str(tmp_path / "pools.json")).collect()] == [("q1", "c", "t", 0.5, 1)]
    first = flow.first_queries(spark.createDataFrame([(i, f"t{i}") for i in (5, 3, 9)], "query_id long, query string"), 2)
    assert [tuple(r) for r in first.collect()] == [("bq01", 3, "t3"), ("bq02", 5, "t5")]
    assert shared_dir(spark)


def test_a_run_without_a_scheduler(spark: SparkSession, tmp_path: Path) -> None:
    manifest = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "doc_id string, title string")
    files = spark.createDataFrame([("a", True), ("b", False), ("b", False)], "doc_id string, is_pdf boolean")
    pages = spark.createDataFrame([("a", 1, "First page. " * 200, "Start"), ("a", 2, "Second page.", ""), ("b", 1, "never read", "")], "doc_id string, page int, text string, heading string")
    assert runner.run_ingest(manifest, files, pages, str(tmp_path)) == 1
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    assert {r["section_heading"] for r in chunks.collect()} == {"Start"} and chunks.where("doc_id <> 'a'").isEmpty()
    assert spark.read.parquet(f"{tmp_path}/coverage").first()["coverage_pct"] == 33.33
    assert spark.read.parquet(f"{tmp_path}/chunk_quality").count() == chunks.count() > 1
    assert runner.run_ingest(manifest.where("doc_id = 'a'"), files, pages, str(tmp_path)) == 0
