"""Metrics, gates, agreement and judging on literal cases."""

from __future__ import annotations

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.operators import agreement, judge, metrics
from corvane.plans import testbed as bed


def measured(spark: SparkSession, ranked: str, labels: dict[str, int], k: int = 10, ks: tuple[int, ...] = (3, 5, 10)) -> dict:
    r = spark.createDataFrame([("q", d, i) for i, d in enumerate(ranked.split(","), 1)], "query_id string, doc_id string, rank int")
    q = spark.createDataFrame([("q", d, x) for d, x in labels.items()], "query_id string, doc_id string, label int")
    return metrics.metrics(r, q, ks=ks, k=k).first().asDict()


def test_metrics(spark: SparkSession) -> None:
    assert measured(spark, "a,b,c", {"a": 1, "b": 1, "c": 0}, 3)["ndcg"] == pytest.approx(1)
    assert measured(spark, "a,b,c", {"c": 1}, 3)["ndcg"] == pytest.approx(0.5)
    assert measured(spark, "a,b,c", {"c": 1}, 2)["ndcg"] == 0
    assert measured(spark, "u,b", {"b": 1}, 2)["ndcg"] == pytest.approx(1 / math.log2(3))
    assert measured(spark, "a,b,c", {})["ndcg"] == 0
    got = measured(spark, "x,a", {"a": 2, "lost": 1})
    assert got["ndcg_exp"] == pytest.approx(3 / math.log2(3) / (3 + 1 / math.log2(3)))
    assert [measured(spark, "a,b,c", x)["mrr"] for x in ({"c": 1}, {"b": 1, "c": 1}, {})] == [pytest.approx(1 / 3), 0.5, 0]
    assert measured(spark, "a,b,c,d", {"a": 1, "c": 1}, ks=(4,))["prec_at_4"] == 0.5
    assert measured(spark, "a,b", {"a": 1, "b": 1})["prec_at_10"] == 1.0


def test_benchmark(spark: SparkSession) -> None:
    r = spark.createDataFrame([("A", "q", "c1", 1), ("A", "q", "c2", 2)], "config string, query_id string, doc_id string, rank int")
    q = spark.createDataFrame([("q", "c1", 1)], "query_id string, doc_id string, label int")
    row = metrics.benchmark_rows(r, q, {"A": 0.01}).first()
    assert (row["ndcg_at_10"], row["mrr"], row["prec_at_3"], row["cost_usd"]) == (1.0, 1.0, 0.5, 0.01)
    rows = spark.createDataFrame([("A", n, n, n, n, n, ms, 0.01) for n, ms in ((1.0, 10.0), (0.0, 20.0))], "config string, ndcg_at_10 double, mrr double, prec_at_3 double, prec_at_5 double, prec_at_10 double, latency_ms double, cost_usd double")
    got = metrics.aggregate(rows).first()
    assert (got["ndcg_at_10"], got["latency_ms"], got["cost_usd"], got["num_queries"]) == (0.5, 15.0, 0.02, 2)


@pytest.mark.parametrize(("a", "c", "passed", "failed"), [(0.5333, 0.5280, True, ""), (0.42, 0.53, False, "A"), (0.50, 0.50, True, "")])
def test_gate(spark: SparkSession, a: float, c: float, passed: bool, failed: str) -> None:
    df = spark.createDataFrame([("A", a), ("C", c)], "config string, ndcg_at_10 double")
    assert tuple(metrics.gate(df).first()) == (passed, failed)
    with pytest.raises(Exception, match="no results"):
        metrics.gate(df.limit(0)).collect()
    assert metrics.winner(df, expected=3).first()["winner"] is None


def test_agreement(spark: SparkSession) -> None:
    n = 12
    items = [f"d{i:02d}" for i in range(n)]
    shuffled = items[3:] + items[:3]

    def ranks(a: list[str], c: list[str]):
        f = lambda x: spark.createDataFrame([("q", d, i) for i, d in enumerate(x, 1)], "query_id string, doc_id string, rank long")
        return agreement.both_ranks(f(a), f(c))

    same, back = ranks(items, items), ranks(items, items[::-1])
    assert agreement.spearman_full(same).first()["rho"] == pytest.approx(1) and agreement.spearman_full(back).first()["rho"] == pytest.approx(-1)
    assert agreement.rbo(same).first()["rbo"] == pytest.approx(1)
    assert tuple(agreement.overlaps(same).first())[1:] == (10, 5, True)
    p, x = 0.9, 0.0
    for d in range(1, n + 1):
        x += len(set(items[:d]) & set(shuffled[:d])) / d * p**d
    assert agreement.rbo(ranks(items, shuffled)).first()["rbo"] == pytest.approx(p**n + (1 - p) / p * x)
    assert -1 <= agreement.spearman_head(ranks(items, shuffled)).first()["rho"] <= 1
    with pytest.raises(Exception, match="differ"):
        agreement.both_ranks(same.select("query_id", "doc_id", F.col("rank_a").alias("rank")), same.limit(3).select("query_id", "doc_id", F.col("rank_c").alias("rank"))).collect()


def test_citations(spark: SparkSession) -> None:
    raw = ['[{"claim":"a","chunk_ids":["x"]},{"chunk_ids":["y"]},{"claim":"b"}]', '"[{\\"claim\\":\\"a\\",\\"chunk_ids\\":[]}]"', '"nonsense"', '{"claim":"a"}', None]
    got = [r["v"] for r in spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", judge.recovered_citations(F.col("r")).alias("v")).orderBy("i").collect()]
    assert [[(c["claim"], c["chunk_ids"]) for c in x] for x in got][:3] == [[("a", ["x"]), ("b", [])], [("a", [])], []]
    assert got[4] == []


def test_fan_out_and_accuracy(spark: SparkSession) -> None:
    cited = spark.createDataFrame([("q", "claim", ["x", "lost"])], "query_id string, claim string, chunk_ids array<string>")
    passages = spark.createDataFrame([("q", "x", "text")], "query_id string, chunk_id string, text string")
    rows = {r["chunk_id"]: r for r in judge.fan_out(cited, passages).collect()}
    assert rows["lost"]["supported"] is False and rows["lost"]["rationale"] == judge.NOT_FOUND and rows["x"]["supported"] is None
    done = judge.judged(judge.fan_out(cited, passages), F.lit(True))
    assert judge.accuracy(done).first()[0] == 0.5 and judge.accuracy(done.limit(0)).first()[0] == 0.0
    assert judge.metrics_for([None, ""]) == ["faithfulness", "answer_relevancy"] and len(judge.metrics_for(["t"])) == 3


def test_labelled_metrics_equal_metrics_without_all_pairs(spark: SparkSession, tmp_path: Path) -> None:
    r = random.Random(5)
    vectors = [(i, [1.0], r.choice([0, 0, 1, None])) for i in range(400)] + [(500, [1.0], 9)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    d, asked = str(tmp_path), [i for i, *_ in vectors if i % 100 == 0]
    ranked = spark.createDataFrame([(q, v, n) for q in asked for n, v in enumerate(r.sample(range(400), 12), 1)], "query_id long, vec_id long, rank int")
    labels = {i: x for i, _, x in vectors}
    pairs = [(q, v, 1 + (q == v)) for q in asked for v in labels if labels[v] is not None and labels[v] == labels[q]]
    want = metrics.metrics(ranked, spark.createDataFrame(pairs, "query_id long, vec_id long, label int"), doc_id="vec_id")
    rows, counts = bed.vector_labels(spark, d, ranked), bed.vector_counts(spark, d)
    assert rows.count() == ranked.count() and counts.count() <= 2 * len(asked) < len(pairs)
    got = metrics.labelled_metrics(rows, counts, doc_id="vec_id")
    flat = lambda df: sorted([round(float(x), 9) for x in row] for row in df.collect())
    assert flat(got) == flat(want) and got.columns == want.columns
