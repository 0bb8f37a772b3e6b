"""Results that must not depend on how rows are dealt, the splitter against a second one, and loaders and steps that fail."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.operators import analytics, exploration, flow, ingest
from corvane.sources import readers


def test_means_do_not_depend_on_the_order_of_rows(spark: SparkSession) -> None:
    r = random.Random(1)
    scores = [(i, f"t{i % 7}", round(r.random(), 4)) for i in range(700)] + [(700 + i, "half", x) for i, x in enumerate((0.6591, 0.6592))] + [(800, "none", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in scores], "doc_id long, title string")
    chunks = docs.select("doc_id", F.col("doc_id").alias("chunk_id"))
    quality = spark.createDataFrame([(i, s) for i, _, s in scores], "chunk_id long, quality_score double")
    got = [{tuple(x) for x in analytics.avg_quality_per_title(docs.repartition(n), chunks, quality.repartition(n, F.rand(n))).collect()} for n in (1, 3, 16)]
    assert got[0] == got[1] == got[2]
    exact = {}
    for _, t, s in scores:
        exact.setdefault(t, []).append(None if s is None else round(s * 10000))
    for title, mean, n in got[0]:
        own = [x for x in exact[title] if x is not None]
        assert n == len(exact[title]) and mean == ((2 * sum(own) + len(own)) // (2 * len(own)) / 10000 if own else None)
    assert next(m for t, m, _ in got[0] if t == "half") == 0.6592


def test_the_last_line_of_the_last_file_counts(spark: SparkSession, tmp_path: Path) -> None:
    line = lambda c, x, pad="": f'{{"query_id":"q","chunk_id":"{c}","label":{x},"rationale":"{pad}"}}\n'
    (tmp_path / "a.json").write_text(line("c", 1) + line("c", 0) + line("d", 1))
    (tmp_path / "b.json").write_text(line("e", 0, "x" * 5000) * 40 + line("c", 1))
    (tmp_path / "c.json").write_text(line("d", 0))
    got = {r["chunk_id"]: r["label"] for r in readers.relevance_labels(spark, str(tmp_path)).collect()}
    assert got == {"c": 1, "d": 0, "e": 0}


def windows(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """First and last-but-one piece of each chunk: from prefix sums, without taking pieces in and out."""
    at = [0]
    for n in lengths:
        at.append(at[-1] + n)
    out, start = [], 0
    while start < len(lengths):
        end = next((e for e in range(start + 1, len(lengths)) if at[e + 1] - at[start] > size), len(lengths))
        out.append((start, end))
        if end == len(lengths):
            break
        start = next(s for s in range(start, end + 1) if s == end or at[end] - at[s] <= overlap and at[end + 1] - at[s] <= size)
    return out


def second_splitter(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    first = min(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[first], separators[first + 1 :]
    pieces = [p for p in re.split(f"(?={re.escape(sep)})", text) if p] if sep else list(text)
    if sep:  # a look-ahead splits overlapping separators too; text.split does not
        cuts = [m.start() for m in re.finditer(re.escape(sep), text)]
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < b]
    out: list[str] = []
    run: list[str] = []
    for p in [*pieces, None]:
        if p is not None and len(p) < size:
            run.append(p)
            continue
        out += ["".join(run[a:b]).strip() for a, b in windows([len(x) for x in run], size, overlap)]
        run = []
        if p is not None:
            out += second_splitter(p, size, overlap, finer) if finer else [p]
    return [x for x in out if x]


@pytest.mark.parametrize(("size", "overlap"), [(20, 5), (50, 0), (40, 39), (1500, 150)])
def test_the_splitter_against_a_second_one(size: int, overlap: int) -> None:
    r = random.Random(size)
    parts = ["\n\n", "\n", ". ", " ", "  ", "word", "longerword", "x" * 30, "é", "a.b", "\n\n\n", "y" * 90]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 400 if size > 1000 else 60)))
        got = ingest.split_text(text, size, overlap)
        assert got == second_splitter(text, size, overlap, ingest.SEPARATORS) and all(len(p) <= size for p in got)
        at = ingest.localised(text, got, overlap)
        assert at == sorted(at) and all(text[a:].startswith(p[: ingest.PROBE]) or p[: ingest.PROBE] not in text[a:] for a, p in zip(at, got, strict=True))


def test_views_of_what_can_be_loaded(spark: SparkSession) -> None:
    def lost() -> None:
        raise OSError("gone")

    bad = lambda: spark.range(3).withColumn("x", F.raise_error(F.lit("cannot read")))
    failed = exploration.register_views({"seen_a": lambda: spark.range(3), "lost_b": lost, "bad_c": bad, "seen_d": lambda: exploration.benchmark_view(spark.range(2).withColumn("config", F.lit("A")).withColumn("query_id", F.lit("q")).withColumn("mrr", F.lit(0.5)).drop("id"))})
    assert set(failed) == {"lost_b", "bad_c"} and failed["lost_b"] == "OSError: gone"
    assert spark.sql("SELECT sum(id) AS s FROM seen_a").first()["s"] == 3 and not spark.catalog.tableExists("lost_b") and not spark.catalog.tableExists("bad_c")
    assert spark.table("seen_d").columns == exploration.BENCHMARK_COLUMNS and spark.sql("SELECT count(latency_ms) AS n, avg(mrr) AS m FROM seen_d").first().asDict() == {"n": 0, "m": 0.5}


def test_a_made_up_drift_history(spark: SparkSession) -> None:
    rows = [tuple(r) for r in exploration.drift_history(spark, "2024-05-20").orderBy("date").collect()]
    assert len(rows) == 14 and str(rows[0][0]) == "2024-05-07" and str(rows[-1][0]) == "2024-05-20"
    assert all(0 <= p <= 0.4 and 0 <= n <= 7 for _, p, n in rows) and len({p for _, p, _ in rows}) > 8
    long = {tuple(r) for r in exploration.drift_history(spark, "2024-05-20", 300).collect()}
    assert set(rows) <= long and 0.08 < sum(p for _, p, _ in long) / 300 < 0.12
    assert {tuple(r) for r in exploration.drift_history(spark, "2024-05-20", seed=6).collect()} != set(rows)


def test_one_run_of_all_steps(spark: SparkSession) -> None:
    ranked = lambda *ids: lambda: spark.createDataFrame([(1, i, n) for n, i in enumerate(ids, 1)], "query_id long, doc_id string, rank int")
    texts = spark.createDataFrame([("a", "alpha"), ("b", "beta"), ("c", "gamma")], "doc_id string, text string")
    cite = lambda p: p.groupBy("query_id").agg(F.lit("a").alias("claim"), F.concat(F.array_sort(F.collect_list("doc_id")), F.array(F.lit("zz"))).alias("chunk_ids"))
    state = flow.orchestrate(ranked("a", "b"), ranked("b", "c"), lambda x: x, cite, texts, F.contains("text", "claim"), top_k=2)
    assert state.error is None and {r["chunk_id"]: r["supported"] for r in state.judgments.collect()} == {"a": True, "b": True, "zz": False}
    assert state.accuracy.first()[0] == pytest.approx(2 / 3)

    def broken(_: object) -> None:
        raise TimeoutError("model")

    failed = flow.orchestrate(ranked("a"), None, lambda x: x, broken, texts, F.lit(True))
    assert failed.error == "TimeoutError: model" and failed.judgments is None


def test_saved_contexts(spark: SparkSession, tmp_path: Path) -> None:
    rows = spark.createDataFrame([("q1", "what?", "b", "two\nlines", 0.5, 2), ("q1", "what?", "a", "one", 0.75, 1), ("q2", "é", "a", None, 0.1, 1)], "query_id string, query string, chunk_id string, text string, score double, rank int")
    readers.write_contexts(rows, str(tmp_path / "c"))
    assert {tuple(r) for r in readers.contexts(spark, str(tmp_path / "c")).collect()} == {tuple(r) for r in rows.collect()}
