"""Drift, term shift, streaks, feedback, ingestion and streaming on literal cases."""

from __future__ import annotations

import datetime as dt
import random
from collections import deque
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import ingest, monitoring
from corvane.sources import readers
from corvane.streaming import feedback as stream


def floats(spark: SparkSession, xs) -> DataFrame:
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def psi_of(b: np.ndarray, c: np.ndarray) -> float:
    edges = np.unique(np.quantile(b, np.linspace(0, 1, 11)))
    if len(edges) < 2:
        return 0.0
    edges[0], edges[-1] = -np.inf, np.inf
    p, q = (np.histogram(x, edges)[0] / len(x) + 1e-4 for x in (b, c))
    return float(((q - p) * np.log(q / p)).sum())


def test_psi(spark: SparkSession) -> None:
    r = np.random.default_rng(1)
    a, near, far, tied = r.normal(size=500), r.normal(size=400), r.normal(5, size=300), r.integers(0, 4, 300).astype(float)
    for b, c in ((a, a), (a, near), (a, far), (tied, a), (a, tied), (np.ones(20), np.full(20, 5.0))):
        assert monitoring.psi(floats(spark, b), floats(spark, c), "x").first()["psi"] == pytest.approx(psi_of(b, c), abs=1e-9)
    with pytest.raises(Exception, match="must not be empty"):
        monitoring.psi(floats(spark, a), floats(spark, []), "x").collect()


def test_embedding_drift(spark: SparkSession) -> None:
    r = np.random.default_rng(2)
    rows = lambda x: spark.createDataFrame([([float(v) for v in y],) for y in x], "embedding array<double>")
    base, cur = rows(r.normal(0, 1, (100, 8))), rows(r.normal(10, 1, (100, 8)))
    assert monitoring.guarded_drift(base, cur).first()["severity"] == "significant"
    none = monitoring.guarded_drift(base, cur.limit(0)).first()
    assert (none["psi"], none["current_size"], none["severity"]) == (0.0, 0, "none")


def texts(spark: SparkSession, *xs: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in xs], "text string")


def test_term_shift(spark: SparkSession) -> None:
    freq = {r["term"]: r["freq"] for r in monitoring.term_frequencies(texts(spark, "tide rope", "Tide tide mast")).collect()}
    assert freq == pytest.approx({"tide": 3 / 5, "rope": 1 / 5, "mast": 1 / 5})
    calm, storm = texts(spark, "oar sail", "oar keel", "sail keel"), texts(spark, "oar sail reef", "reef keel", "reef reef")
    assert monitoring.term_shift(calm, calm).collect() == []
    assert [r["term"] for r in monitoring.new_terms(calm, storm).collect()] == ["reef"] and monitoring.new_terms(storm, calm).collect() == []
    moved = {r["term"]: r["delta"] for r in monitoring.term_shift(calm, storm, 0.1).collect()}
    assert moved == pytest.approx({"reef": 4 / 7, "oar": 1 / 7 - 1 / 3, "sail": 1 / 7 - 1 / 3, "keel": 1 / 7 - 1 / 3})
    assert [r["term"] for r in monitoring.top_shifts(monitoring.term_shift(calm, storm, 0.1), 1).collect()] == ["reef"]


@pytest.mark.parametrize(("series", "eps", "want"), [([0.61], 0, 0), ([0.4, 0.4, 0.4], 0, 0), ([0.3, 0.5, 0.9], 0, 0), ([0.77, 0.71, 0.52], 0, 2), ([0.91, 0.62, 0.44, 0.43, 0.1], 0, 4), ([0.2, 0.66, 0.6, 0.35], 0, 2), ([0.9, None, 0.7, 0.8], 0, 0), ([0.9, None, 0.7, 0.6], 0, 2), ([0.55, 0.54, 0.53], 0.03, 0), ([0.6, 0.5, 0.4], 0.03, 2)])
def test_streaks(spark: SparkSession, series: list, eps: float, want: int) -> None:
    df = spark.createDataFrame([("m", dt.date(2026, 1, 1 + i), x) for i, x in enumerate(series)], "metric string, day date, score double")
    assert monitoring.streaks(df, eps).first()["streak"] == want


def test_alert(spark: SparkSession) -> None:
    df = spark.createDataFrame([("faithfulness", dt.date(2026, 1, i), 1.0 - i / 10) for i in range(1, 5)], "metric string, day date, score double")
    got = monitoring.regression_alert(monitoring.streaks(df)).first()
    assert got["is_regressing"] and got["alert"] == "Quality regression detected on 2026-01-04: faithfulness: 3 consecutive days declining (latest=0.6000)"


def feedback(spark: SparkSession, up: int, down: int) -> DataFrame:
    rows = [("q", "up")] * up + [("q_bad" if i % 2 else None, "down") for i in range(down)]
    return spark.createDataFrame(rows, "query_id string, reaction string")


def test_feedback(spark: SparkSession) -> None:
    for (up, down), want in {(2, 1): (0.3333, False), (0, 2): (1.0, False), (1, 4): (0.8, True), (9, 1): (0.1, False)}.items():
        got = monitoring.feedback_summary(feedback(spark, up, down)).first()
        assert (got["down_rate"], got["alert"]) == want
    assert [tuple(r) for r in monitoring.worst_queries(feedback(spark, 1, 4)).collect()] == [("q_bad", 2)]


def test_ingestion(spark: SparkSession) -> None:
    stored = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 2)], "id string, h string, n int")
    new = spark.createDataFrame([("b", "hX", None), ("c", "h3", 3)], "id string, h string, n int")
    rows = {r["id"]: (r["h"], r["n"], r["action"]) for r in ingest.upsert(stored, new, "id").collect()}
    assert rows == {"a": ("h1", 1, "keep"), "b": ("hX", 2, "update"), "c": ("h3", 3, "insert")}
    assert [r["id"] for r in ingest.insert_if_absent(stored, new, "id").collect()] == ["c"]
    assert [tuple(r) for r in ingest.hash_drift(stored, new, "id", "h").collect()] == [("b", "h2", "hX")]
    assert tuple(ingest.coverage(stored, new, "id").first()) == (2, 1, 50.0) and tuple(ingest.coverage(stored.limit(0), new, "id").first()) == (0, 0, 0.0)
    with pytest.raises(Exception, match="missing from the download"):
        ingest.require_all(stored, new.select("id"), "id").collect()


def test_splitter_invariants() -> None:
    r = np.random.default_rng(0)
    text = "\n\n".join(". ".join(" ".join("w" * int(n) for n in r.integers(1, 12, 30)) for _ in range(6)) for _ in range(8)) + "x" * 4000
    parts = ingest.split_text(text)
    places = ingest.localised(text, parts)
    assert all(0 < len(p) <= ingest.CHUNK_SIZE for p in parts) and places == sorted(places)
    assert all(text[a : a + len(p)] == p for a, p in zip(places, parts, strict=True))
    assert max(a + len(p) - b for (a, p), b in zip(zip(places, parts), places[1:])) <= ingest.CHUNK_OVERLAP
    assert ingest.split_text("") == [] and ingest.split_text("short") == ["short"]


def recursive_pieces(text: str, size: int, overlap: int, seps: tuple[str, ...]) -> list[str]:
    """The splitter once more: units cut at the first separator that occurs, then packed greedily."""
    while seps and seps[0] and seps[0] not in text:
        seps = seps[1:]
    sep, rest = (seps[0], seps[1:]) if seps else ("", ())
    cut = text.split(sep) if sep else []
    units = [u for u in [cut[0], *(sep + c for c in cut[1:])] if u] if sep else list(text)  # a separator begins what follows
    out: list[str] = []
    window: deque[str] = deque()
    for u in [*units, None]:
        if u is None or len(u) >= size:
            if window:
                out.append("".join(window))
                window.clear()
            if u is not None:
                out += recursive_pieces(u, size, overlap, rest) if rest else [u]
            continue
        if window and sum(map(len, window)) + len(u) > size:
            out.append("".join(window))
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(u) > size):
                window.popleft()
        window.append(u)
    return [p.strip() for p in out if p.strip()]


def test_splitter_on_recorded_pieces_and_by_brute_force(spark: SparkSession) -> None:
    for text, size, overlap, want, at in (
        ("aa bb. cc dd\n\nee ff", 8, 3, ["aa bb", ". cc dd", "ee ff"], [0, 5, 14]), ("one two three four five", 11, 4, ["one two", "two three", "four five"], [0, 4, 14]),
        ("x" * 20, 8, 3, ["x" * 8, "x" * 8, "x" * 8, "x" * 5], [0, 5, 10, 15]), ("a\nb\nc\n\nd e f g h", 5, 2, ["a\nb\nc", "d e", "e f", "f g", "g h"], [0, 7, 9, 11, 13]),
    ):
        assert ingest.split_text(text, size, overlap) == want
        assert ingest.localised(text, want, overlap) == at
    r = random.Random(6)
    texts = ["".join(r.choice(["\n\n", "\n", ". ", " ", "a", "bc", "def", "ghijk"]) for _ in range(r.randint(0, 120))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, full_text string")
    rows = ingest.chunk_documents(df, size=30, overlap=8).orderBy("doc_id", "chunk_index").collect()
    got = {i: [x["chunk_text"] for x in rows if x["doc_id"] == i] for i in range(len(texts))}
    assert got == {i: recursive_pieces(t, 30, 8, ingest.SEPARATORS) for i, t in enumerate(texts)}
    heads = spark.createDataFrame([(1, 0, "A"), (1, 20, "B")], "doc_id long, offset long, heading string")
    for x in ingest.emitted_chunks(df.where("doc_id < 3"), heads, size=30, overlap=8).collect():
        assert x["section_heading"] == (None if x["doc_id"] != 1 else "A" if x["pos"] < 20 else "B")
        assert x["token_count"] == len(x["chunk_text"].split())


def test_windows_and_regression_run(spark: SparkSession) -> None:
    now = dt.datetime(2026, 3, 1)
    rows = spark.createDataFrame([(h, now - dt.timedelta(hours=h)) for h in range(0, 40 * 24, 6)], "h long, ts timestamp")
    base, cur = monitoring.drift_windows(rows, "ts", "2026-03-01")
    assert {r["h"] for r in base.collect()} == {h for h in range(0, 960, 6) if 30 * 24 < h <= 37 * 24}
    assert {r["h"] for r in cur.collect()} == {6, 12, 18, 24}
    assert {r["h"] for r in monitoring.trailing(rows, "ts", "2026-03-01").collect()} == {h for h in range(0, 960, 6) if h <= 168}
    day = lambda i: dt.date(2026, 1, i)
    history = spark.createDataFrame([("m", day(1), 0.9), ("m", day(2), 0.8), ("m", day(3), 0.7), ("m", day(4), 5.0)], "metric string, day date, score double")
    today = spark.createDataFrame([("m", q, day(4), x) for q, x in (("a", 0.2), ("b", 0.4), ("c", 9.0), (None, 9.0))], "metric string, query_id string, day date, score double")
    got = monitoring.regression_run(history, today, 2).first()
    assert (got["streak"], round(got["latest"], 9), got["regressing"]) == (3, 0.3, True)  # the day is replaced, the third query left out


def test_positions(spark: SparkSession) -> None:
    ids = [f"d{i * 7919 % 1000:03d}" for i in range(1000)]
    df = spark.createDataFrame([(i, 1) for i in ids], "doc_id string, _n long").repartition(5)
    assert {r["doc_id"]: r["vec_id"] for r in ingest.numbered(df.select("doc_id"), "doc_id", "vec_id").collect()} == {d: i for i, d in enumerate(sorted(ids))}
    assert ingest.numbered(df.select("doc_id").limit(0), "doc_id", "vec_id").collect() == []


def test_files(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    got = {Path(r["path"]).name: r["is_pdf"] for r in ingest.checked_files(readers.binary_files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": True, "b.pdf": False}
    (tmp_path / "l.jsonl").write_text('{"query_id":"q","chunk_id":"c","label":0,"rationale":""}\n{"query_id":"q","chunk_id":"c","label":1,"rationale":""}\n')
    assert [tuple(r) for r in readers.relevance_labels(spark, str(tmp_path / "l.jsonl")).collect()] == [("q", "c", 1)]
    (tmp_path / "bad.jsonl").write_text("nonsense\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "benchmark_queries").collect()
    readers.save_index({"terms": spark.range(3).toDF("df")}, str(tmp_path / "index"))
    assert readers.load_index(spark, str(tmp_path / "index"), ["terms"])["terms"].count() == 3


def test_weekly_stream_equals_batch(spark: SparkSession, tmp_path: Path) -> None:
    rows = [(dt.datetime(2024, 1, 1 + i), "up" if i % 3 else "down", "q") for i in range(28)]
    df = spark.createDataFrame(rows, "created_at timestamp, reaction string, query_id string")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = stream.start(source, str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination(120)
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in stream.weekly(df).collect()}
    assert closed and closed < batch and len(batch - closed) <= 2  # the last weeks are still open


def test_headings(spark: SparkSession) -> None:
    spans = spark.createDataFrame([("d", 1, 0, "Title", 14.0, 0), ("d", 1, 1, "body", 9.0, 0), ("d", 1, 2, "bold", 9.0, 16), ("d", 1, 3, "x" * 120, 20.0, 0)], "doc_id string, page int, span_no int, text string, size double, flags int")
    row = ingest.heading_spans(spans).first()
    assert row["headings"] == ["Title", "bold"] and row["text"].startswith("Title body bold x")
    at = spark.createDataFrame([("d", 5), ("d", 0), ("e", 9)], "doc_id string, pos long")
    heads = spark.createDataFrame([("d", 0, ""), ("d", 3, "A"), ("d", 5, "B"), ("d", 6, "C")], "doc_id string, offset long, heading string")
    assert {(r["doc_id"], r["pos"]): r["heading"] for r in ingest.nearest_heading(at, heads).collect()} == {("d", 5): "B", ("d", 0): None, ("e", 9): None}
    assert F is not None
