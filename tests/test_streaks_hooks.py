"""Streams of daily scores and error rates, stage hooks, and late interaction, against batch forms and brute force."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import analytics, late_interaction, monitoring
from corvane.plans import hooks
from corvane.streaming import streaks as stream

DAILY = "metric string, ts timestamp, score double"


def day(n: int) -> dt.datetime:
    return dt.datetime(2024, 3, 1) + dt.timedelta(days=n)


def fed(spark: SparkSession, folder: Path, batches: list[list[tuple]], schema: str, make) -> DataFrame:
    """What a stream over ``batches`` gives; the stream stops after each batch and is started again from its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        source = spark.readStream.schema(schema).parquet(str(folder / "in"))
        stream.start(make(source), str(folder / "out"), str(folder / "state")).awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def test_streaks_of_a_stream_are_those_of_its_days(spark: SparkSession, tmp_path: Path) -> None:
    r = random.Random(2)
    history = [(m, day(n), None if r.random() < 0.1 else round(r.random() if m == "a" else 1 - n / 40 + (n % 9 == 0), 3)) for m in ("a", "b", "c") for n in range(30) if not (m == "c" and n > 12)]
    early, late = [x for x in history if x[1] < day(15)], [x for x in history if x[1] >= day(15)]
    moved = [x for x in early if x[1] == day(14)]  # comes with the next batch, in time, as the watermark is two days behind
    r.shuffle(early)
    batches = [[x for x in early if x not in moved], [*moved, *late], [("end", day(90), 0.0), ("a", day(3), 0.0)]]  # the last row is for a closed day
    closed = fed(spark, tmp_path, batches, DAILY, stream.streaks)
    known = spark.createDataFrame([(m, t.date(), s) for m, t, s in history], "metric string, day date, score double")
    want = {tuple(x) for x in monitoring.streaks(known).select("metric", "streak", "latest", "day", "regressing").collect()}
    assert {tuple(x) for x in stream.latest(closed).collect()} == want
    assert closed.groupBy("metric", "day").count().where("count > 1").isEmpty() and closed.where("metric = 'a'").count() == sum(m == "a" and s is not None for m, _, s in history)
    for n in (5, 20):  # and so on every day
        part = {tuple(x) for x in monitoring.streaks(known.where(F.col("day") <= day(n).date())).select("metric", "streak", "latest", "day", "regressing").collect()}
        assert part == {tuple(x) for x in stream.latest(closed.where(F.col("day") <= day(n).date())).collect()}


def test_daily_error_rates(spark: SparkSession, tmp_path: Path) -> None:
    r = random.Random(3)
    rows = [(day(0) + dt.timedelta(minutes=r.randint(0, 6 * 1440)), r.random() < 0.2) for _ in range(300)]
    rows.sort(key=lambda x: x[0].date())
    batches = [rows[:150], rows[150:], [(day(40), False)]]
    got = {tuple(x) for x in fed(spark, tmp_path, batches, "ts timestamp, is_error boolean", stream.error_rates).select("day", "requests", "errors", "error_rate").collect()}
    df = spark.createDataFrame(rows, "ts timestamp, is_error boolean")
    assert got == {tuple(x) for x in stream.error_rates(df).collect()}
    assert got == {tuple(x) for x in analytics.daily_error_rate(df.withColumn("day", F.to_date("ts")), "day", "is_error").collect()}


def test_hooks_count_what_stages_wrote(spark: SparkSession) -> None:
    told, alerts, ticks = [], [], iter(range(100))
    stages = hooks.Stages(spark, lambda stage, m: told.append((stage, m)), alerts.append, lambda: float(next(ticks)))
    seen = []
    numbers = stages.run("numbers", spark.range(10), {"total": F.sum("id")}, {"many": lambda m: m["rows"] > 5, "few": lambda m: m["rows"] < 5})
    even = stages.run("even", numbers.where("id % 2 = 0"), {"top": F.max("id")})
    assert told == [("numbers", {"rows": 10, "total": 45}), ("even", {"rows": 5, "top": 8})] and alerts == ["many"]
    assert even.count() == 5 and [t.seconds for t in stages.traces] == [1.0, 1.0] and stages.failures == [] and not seen
    assert told[1][1]["rows"] == numbers.where("id % 2 = 0").count()


def test_a_failing_hook_fails_nothing(spark: SparkSession) -> None:
    def broken(*_: object) -> None:
        raise ConnectionError("tracker is down")

    stages = hooks.Stages(spark, broken, broken)
    assert stages.run("a", spark.range(3), rules={"always": lambda m: True}).count() == 3
    assert stages.failures == ["ConnectionError: tracker is down"] * 2 and stages.traces[0].error is None
    with pytest.raises(Exception, match="bad row"):
        stages.run("b", spark.range(3).withColumn("x", F.raise_error(F.lit("bad row"))))
    assert stages.traces[1].error and spark.sparkContext.getLocalProperty("spark.job.description") is None


def letters(texts: list[str]) -> list[list[list[float]]]:
    """A vector for each word, from its letters."""
    assert len(texts) <= late_interaction.BATCH
    return [[[float(w.count(c)) - 0.3 for c in "abcdefgh"] for w in t.split()] for t in texts]


def test_late_interaction_is_the_sum_of_maxima(spark: SparkSession) -> None:
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(n))
    docs = {i: text(r.randint(1, 40)) for i in range(150)} | {200: "", 201: None, 202: text(400), 203: text(3)}
    docs[204] = docs[203]
    asked = {i: text(r.randint(1, 8)) for i in range(12)} | {50: "", 51: None, 52: docs[203]}
    df = spark.createDataFrame([*docs.items(), (None, "abc")], "doc_id long, text string").withColumns({"k": F.lit(1), "n": F.lit("clash")})
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    index = late_interaction.TokenIndex.build(late_interaction.token_vectors(df, "doc_id", letters))
    vectors = late_interaction.token_vectors(queries, "query_id", letters)
    unit = lambda t: np.array([v / np.linalg.norm(v) for v in map(np.array, letters([t])[0][:256])])
    want = []
    for q, t in asked.items():
        scores = [(-round(float((unit(t) @ unit(x).T).max(axis=1).sum()), 9), i) for i, x in docs.items() if t and x]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:7], 1)]
    got = sorted((x["query_id"], x["rank"], x["doc_id"], round(x["score"], 9)) for x in index.search(vectors, 7, probes=len(index.centers)).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-8)
    few = {(x["query_id"], x["doc_id"]) for x in index.search(vectors, 7, probes=3).collect()}
    assert len(few & {(x[0], x[2]) for x in want}) >= 0.9 * len(want)
    late_interaction.QUERY_BYTES, whole = 600, late_interaction.QUERY_BYTES
    try:
        assert sorted((x["query_id"], x["rank"], x["doc_id"]) for x in index.search(vectors, 7, probes=len(index.centers)).collect()) == [x[:3] for x in got]
    finally:
        late_interaction.QUERY_BYTES = whole
    assert index.search(vectors.limit(0), 5).count() == 0
    none = late_interaction.TokenIndex.build(late_interaction.token_vectors(df.limit(0), "doc_id", letters))
    assert none.search(vectors, 5).count() == 0
