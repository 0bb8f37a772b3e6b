"""Subword counts, judge batches and latencies against second implementations."""

from __future__ import annotations

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.operators import judge_batches, latency, subwords
from corvane.sources.snapshots import Conflict, SnapshotTable

vocabulary = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
DATA = Path("/root/testdata/sf0.001/documents.parquet")


def awkward() -> list[str | None]:
    r = random.Random(5)
    out: list[str | None] = [None, "", " ", "a", "  two  spaces \n\n x", "naïve café", "日本語のテキスト", " x y\x1c z\x85", "it's we'll I'M", "a" * 3000, "ab" * 2000, "1234567 89", "🙂🙃 ok", "x́̂", "<|endoftext|>"]
    letters = "etaoin shrdlu\n\t.,'!?0123456789éß中 "
    return out + ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(60)]


def test_counts_equal_the_tokenizer(spark: SparkSession) -> None:
    ranks = subwords.ranks_of(vocabulary.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(awkward())) + [(1, "again"), (None, "no key"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"token_count": F.lit("old"), "w": F.lit("clash")})
    if DATA.exists():
        df = df.unionByName(spark.read.parquet(str(DATA)).select("doc_id", "text", F.lit("").alias("token_count"), F.lit("").alias("w")))
    got = subwords.token_counts(df, ranks, vocabulary.PATTERN).collect()
    assert len(got) == df.count() and all(r["w"] is not None for r in got)
    assert [(r["text"], r["token_count"]) for r in got if r["token_count"] != len(own.encode_ordinary(r["text"] or ""))] == []
    assert subwords.token_counts(df.limit(0), ranks, vocabulary.PATTERN).count() == 0


def test_merges_of_one_word() -> None:
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")} | {b"ab": 10, b"bc": 11, b"abc": 12, b"aa": 13, b"aaa": 14}
    assert [subwords.merged_length(w, ranks) for w in (b"abc", b"abcab", b"aaaa", b"aaaaa", b"bca", b"cc", b"")] == [1, 2, 2, 2, 2, 2, 0]


CITED = [("q1", "c1", ["a", "b", "zz"]), ("q1", "c1", ["a"]), ("q2", "c2", ["a"]), ("q2", None, ["a"]), ("q3", "c3", [None]), ("q4", "c4", [])]
PASSAGES = [("q1", "a", "text c1"), ("q1", "b", "other"), ("q2", "a", "no answer"), ("q3", "x", "unused")]


def flaky(claim: str, text: str) -> tuple[bool, str] | None:
    if text == "no answer":
        raise TimeoutError("late")
    return None if text == "other" else (claim in text, "")


def patient(claim: str, text: str) -> tuple[bool, str]:
    return claim in text, "looked"


def test_judging_is_taken_up_where_it_stopped(spark: SparkSession, tmp_path: Path) -> None:
    run = judge_batches.JudgeRun(SnapshotTable(spark, str(tmp_path / "v")))
    cited = spark.createDataFrame(CITED, "query_id string, claim string, chunk_ids array<string>")
    passages = spark.createDataFrame(PASSAGES, "query_id string, chunk_id string, text string")
    assert run.run(cited, passages, flaky) == {"open": 4, "judged": 1, "unretrieved": 1, "failed": 2}
    errors = judge_batches.run_judge(spark.createDataFrame([("q", "c", "i", "no answer"), ("q", "c", "j", "other"), ("q", "c", "k", "c")], "query_id string, claim string, chunk_id string, text string"), flaky)
    assert {r["chunk_id"]: r["error"] for r in errors.collect()} == {"i": "TimeoutError: late", "j": "no verdict", "k": None}
    assert run.run(cited, passages, patient) == {"open": 2, "judged": 2, "unretrieved": 0, "failed": 0}
    assert run.run(cited, passages, patient) == {"open": 0, "judged": 0, "unretrieved": 0, "failed": 0}
    got = {(r["query_id"], r["claim"], r["chunk_id"]): (r["supported"], r["rationale"]) for r in run.verdicts().collect()}
    assert got == {("q1", "c1", "a"): (True, ""), ("q1", "c1", "b"): (False, "looked"), ("q1", "c1", "zz"): (False, judge_batches.judge.NOT_FOUND), ("q2", "c2", "a"): (False, "looked")}
    assert run.verdicts().count() == 4
    assert {r["query_id"]: r["citation_accuracy"] for r in judge_batches.accuracy_by_query(run.verdicts()).collect()} == {"q1": pytest.approx(1 / 3), "q2": 0}
    with pytest.raises(Conflict):
        run.table.commit(run.verdicts().limit(0), base=0)


class Ticking:
    def __init__(self) -> None:
        self.now = 100.0

    def __call__(self) -> float:
        return self.now


def slow(text: str, watch: latency.Stopwatch) -> str:
    watch.clock.now += float(text) / 1000
    watch.wait(lambda: setattr(watch.clock, "now", watch.clock.now + 7))
    return text.upper()


def test_latency(spark: SparkSession) -> None:
    r = random.Random(1)
    values = [0.0, 0.0005, *[round(r.lognormvariate(3, 2), 6) for _ in range(400)]]
    rows = [(i, str(v)) for i, v in enumerate(values)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    timed = latency.timed_rows(df, "id", "text", slow, Ticking).withColumn("config", F.when(F.col("id") % 3 == 0, "A").otherwise("B"))
    got = {r["id"]: r["latency_ms"] for r in timed.collect()}
    assert got == {i: pytest.approx(v, abs=1e-6) for i, v in enumerate(values)} | {1000: 0.0}
    whole = latency.summary(latency.histogram(timed, ["config"]), ["config"]).collect()
    parts = latency.merged(*[latency.histogram(timed.where(f"id % 4 = {i}"), ["config"]) for i in range(4)], keys=["config"])
    for rows_ in (whole, latency.summary(parts, ["config"]).collect()):
        for row in rows_:
            own = sorted(v for i, v in got.items() if (i % 3 == 0) == (row["config"] == "A"))
            exact = own[math.ceil(1 + 0.95 * (len(own) - 1)) - 1]
            assert row["n"] == len(own) and row["mean_ms"] == pytest.approx(sum(own) / len(own)) and row["p95_ms"] == pytest.approx(exact, rel=0.0101)
    bench = spark.createDataFrame([("A", 3), ("B", 9000)], "config string, query_id long")
    joined = latency.with_latency(bench, timed.withColumnRenamed("id", "query_id")).collect()
    assert {r["query_id"]: r["latency_ms"] for r in joined} == {3: pytest.approx(values[3], abs=1e-6), 9000: None}
    assert latency.summary(latency.histogram(timed.limit(0), ["config"]), ["config"]).count() == 0
