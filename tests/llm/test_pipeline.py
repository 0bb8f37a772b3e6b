"""The pipeline's stages, each on its own input, and the whole against its parts by brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline as cp
from corvane.llm import ngram_jaccard
from corvane.sources import store
from tests.llm.conftest import prose
from tests.llm.test_ngram_jaccard import brute
from tests.llm.test_quality_lines import base

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed: int, n: int) -> str:
    w = prose(seed, n).split()
    return " ".join(w[: n // 2]).capitalize() + ". " + " ".join(w[n // 2 :]).capitalize() + "."


def rows() -> list[tuple]:
    out = [(i, text(i, 80), "en", f"src{i % 3}", None) for i in range(40)]
    out += [(100 + i, text(i, 80).upper(), "en", "src0", 1) for i in range(5)]  # copies
    out += [(200 + i, text(i, 80) + " extra words here.", "en", "src0", 1) for i in range(10, 14)]  # near copies
    out += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "too short", "en", "s", 0), (303, " | ".join(prose(9, 40).split()), "en", "s", 0), (None, text(77, 60), None, None, None)]
    out += [(304, "Of Of Of Of " * 30 + ".", "en", "s", 0)]
    return out


@pytest.fixture(scope="module")
def folder(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> str:
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(303, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark: SparkSession, folder: str) -> None:
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), [r[:2] for r in rows()]
    out = docs
    results = []
    for _, stage in cp.STAGES[:-1]:
        before = {(r["doc_id"], r["text"]) for r in out.collect()}
        path = f"{folder}/stage{len(results)}"
        stage(spark, out, folder).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == cp.COLUMNS
        results.append([(r["doc_id"], r["text"]) for r in out.collect()])
        assert set(results[-1]) <= before
    # rules
    assert all(not base(t)[5] for _, t in results[0])
    assert {300, 301, 302, 303, 304}.isdisjoint(i for i, _ in results[0]) and len(results[0]) == 50
    # copies: the largest identifier stays
    groups = defaultdict(list)
    for i, t in results[0]:
        groups[hashlib.sha256(t.lower().encode()).digest()].append(i)
    assert sorted(i or -1 for i, _ in results[1]) == sorted(max((x if x is not None else -1) for x in g) for g in groups.values())
    # near copies: the least identifier of each group stays
    want = sorted(str(i) for i, _, root in brute(results[1], 5, 80) if i is None or i == root)
    assert sorted(str(i) for i, _ in results[2]) == want
    # mixing keeps clean documents and repeats none
    assert len(results[3]) == len(results[2]) == len(set(results[3]))
    assert kept


def test_quality_stage_removes_failing_lines(spark: SparkSession) -> None:
    a, b = text(1, 60), text(2, 60)
    docs = spark.createDataFrame([(1, f"Home\n{a}\n\nCookies | Login\n{b}\n", "en", "s", 7), (2, f"{a}\n \n{b}", "en", "s", 7), (3, f"{a}\n" + "Home\n" * 500, "en", "s", 7)], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.quality_stage(spark, docs, "").collect()}
    assert got == {i: (t, len(t)) for i, t in ((1, f"{a}\n\n{b}\n"), (2, f"{a}\n \n{b}"))}


@pytest.mark.parametrize("toxic", [0, 1])
def test_mixing_keeps_an_all_clean_table(spark: SparkSession, tmp_path: Path, toxic: int) -> None:
    d = str(tmp_path)
    clean = [(i, text(i, 80), "en", "s", 1) for i in range(2000)]
    spark.createDataFrame(clean, SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 2000, 2)] + [(9000 + i, 0, toxic * (i % 2)) for i in range(20)]
    rough = [(9000 + i, "zz ## | " * 30, "en", "s", 1) for i in range(20)]  # so that rough and toxic are known, with few tokens
    docs = spark.createDataFrame(clean + rough, SCHEMA)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    kept = {r["doc_id"] for r in cp.mixing_stage(spark, docs, d).collect()}
    assert {r[0] for r in clean} <= kept


def test_run_packs_what_is_left(spark: SparkSession, folder: str) -> None:
    got = cp.run(spark, folder).collect()
    ids = {r["doc_id"] for r in got}
    assert {5, 10, 11, 12, 13, 100, 101, None} <= ids and {0, 1, 210, 303}.isdisjoint(ids)
    assert sum(r["piece"] == 0 for r in got) == len(got)
    assert max(r["offset"] + r["length"] for r in got) <= cp.CAPACITY


def test_empty_tables(spark: SparkSession, tmp_path: Path) -> None:
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert cp.run(spark, d).collect() == []


def test_similar_texts_are_found_without_broadcasts_that_grow(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """The third stage: survivors of the screen over their limit, and every table that grows with them, meet by shuffle."""
    plans: dict[str, str] = {}

    def kept(df: DataFrame, name: str) -> DataFrame:
        plans[name] = plans.get(name, "") + df._jdf.queryExecution().executedPlan().toString()
        return store.stored(df, name)

    monkeypatch.setattr(ngram_jaccard, "stored", kept)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_BYTES", 0)
    rows = [(10 * i + j, " ".join(f"w{i}x{n}" for n in range(40)) + f" end{j}", "en", "s", 1) for i in range(6) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.ngram_jaccard_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == [10 * i for i in range(6)]
    assert not [name for name, plan in plans.items() if "BroadcastHashJoin" in plan]
