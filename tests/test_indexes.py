"""Block index, live index and vector index against what they must equal."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import block_index, dense, ingest, live_index, sparse, sparse_lists
from corvane.operators.live_index import LiveIndex
from corvane.operators.vector_index import VectorIndex, fitted, recall
from corvane.plans import registry
from corvane.sources import readers, store
from corvane.sources.snapshots import Conflict, SnapshotTable
from tests.oracle import compare

VOCABULARY = [f"w{i}" for i in range(60)]


def passages(seed: int, n: int) -> dict[int, str | None]:
    """Texts of words with falling frequencies, some empty or null."""
    r = random.Random(seed)
    words = lambda k: " ".join(VOCABULARY[min(int(r.expovariate(0.08)), 59)] for _ in range(k))
    return {i: r.choice([None, "", "?!"]) if i % 29 == 0 else words(r.randint(1, 60)) for i in range(n)}


def frame(spark: SparkSession, docs: dict[int, str | None]) -> DataFrame:
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def asked(spark: SparkSession) -> DataFrame:
    texts = ["w0 w1", "w30 w31 w30", "w59", "w40 w2 w55 w0", "nothing", "", "w0", "w50 w51 w52"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def rows(df: DataFrame) -> list[tuple]:
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in df.collect())


def anew(spark: SparkSession, docs: DataFrame, k: int) -> list[tuple]:
    terms = sparse.query_terms(asked(spark))
    return rows(sparse.search(sparse.bm25_scores(docs, terms), docs, terms, k))


@pytest.mark.parametrize("k", [1, 7, 400])
def test_blocks_give_the_same_lists(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, k: int) -> None:
    monkeypatch.setattr(block_index, "GROUP_DOCS", 8)
    docs = frame(spark, passages(1, 300))
    index = block_index.build_blocks(docs)
    assert index["blocks"].agg(F.max(F.size("entries"))).first()[0] <= 8
    assert rows(block_index.bounded_top_k(index, asked(spark), k)) == anew(spark, docs, k)
    counts = block_index.blocks_read(index, asked(spark), k).first()
    assert counts["read"] == counts["blocks"] if k == 400 else counts["read"] < {1: 0.6, 7: 0.95}[k] * counts["blocks"]


def test_blocks_of_nothing(spark: SparkSession) -> None:
    index = block_index.build_blocks(frame(spark, {}))
    assert block_index.bounded_top_k(index, asked(spark), 5).count() == 0


def test_an_index_after_changes_is_one_built_anew(spark: SparkSession, tmp_path: Path) -> None:
    r, docs = random.Random(4), passages(2, 120)
    index = LiveIndex(spark, str(tmp_path / "i"))
    assert index.apply(frame(spark, docs), name="first") == 1
    for step in range(3):
        changed = {i: t for i, t in passages(10 + step, 200).items() if r.random() < 0.15}
        removed = [i for i in range(220) if r.random() < 0.1]
        lost = spark.createDataFrame([(i,) for i in [*removed, None]], "doc_id long")
        n = index.apply(frame(spark, changed), lost, name=f"step {step}")
        assert index.apply(frame(spark, {0: "not again"}), name=f"step {step}") == n
        docs = {i: t for i, t in docs.items() if i not in removed} | changed
        if step == 1:
            index.compact()
            assert index.segments().count() == 1
    now = frame(spark, docs)
    assert sorted(r["doc_id"] for r in index.parts()["documents"].collect()) == sorted(docs)
    want = {r["term"]: (r["df"], round(r["idf"], 9), round(r["avgdl"], 9)) for r in sparse.statistics(now).collect()}
    assert {r["term"]: (r["df"], round(r["idf"], 9), round(r["avgdl"], 9)) for r in index.parts()["statistics"].collect()} == want
    assert rows(index.search(asked(spark), 10)) == anew(spark, now, 10)
    index.compact()
    index.clean()
    assert all(t.versions() and len(t.versions()) == 1 for t in index.tables.values())
    assert rows(index.search(asked(spark), 10)) == anew(spark, now, 10)


def test_half_a_change_does_not_show(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    docs = passages(3, 60)
    index = LiveIndex(spark, str(tmp_path / "i"))
    index.apply(frame(spark, docs))
    before = rows(index.search(asked(spark), 10))
    commit = index.tables["segments"].commit
    with monkeypatch.context() as m:
        m.setattr(index.tables["segments"], "commit", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            index.apply(frame(spark, {1: "w0 w0 w0", 500: "w59"}), name="late")
    assert index.tables["segments"].commit == commit and rows(index.search(asked(spark), 10)) == before
    index.apply(frame(spark, {1: "w0 w0 w0", 500: "w59"}), name="late")
    assert rows(index.search(asked(spark), 10)) == anew(spark, frame(spark, docs | {1: "w0 w0 w0", 500: "w59"}), 10)
    stale = index.tables["segments"].snapshot().version
    index.apply(frame(spark, {2: "w1"}))
    with pytest.raises(Conflict):
        index.tables["segments"].commit(index.segments(), mode="overwrite", base=stale)


def grouped(seed: int, n: int, dim: int = 16) -> list[tuple]:
    """Vectors around 20 directions; a third of all lie around one of them."""
    r = np.random.default_rng(seed)
    centers = r.standard_normal((20, dim))
    own = np.where(r.random(n) < 0.33, 0, r.integers(0, 20, n))
    return [(i, (centers[c] + 0.4 * r.standard_normal(dim)).tolist()) for i, c in enumerate(own)]


def test_vector_lists(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    from corvane.operators import vector_index

    monkeypatch.setattr(vector_index, "PART_ROWS", 100)
    corpus = spark.createDataFrame([*grouped(1, 2000), (2001, None), (None, [1.0] * 16), (2002, [0.0] * 16)], "vec_id long, embedding array<double>").withColumn("list", F.lit("clash"))
    queries = corpus.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = dense.cosine_top_k(corpus.where("vec_id is not null"), queries, 10, doc_id="vec_id")
    index = VectorIndex.build(corpus)
    assert index.filed.count() == 2001 and index.probes < len(index.centers) <= 44
    assert index.filed.groupBy("list", "part").count().agg(F.max("count")).first()[0] <= 200
    by = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 8)) for r in df.collect())
    assert by(index.search(queries, 10, probes=len(index.centers))) == by(exact)
    got = recall(index.search(queries, 10), exact, doc_id="vec_id").first()
    assert got["queries"] == 80 and got["wanted"] == 800 and got["recall"] >= 0.9
    few = recall(index.search(queries, 10, probes=1), exact, doc_id="vec_id").first()
    assert few["recall"] < got["recall"]
    assert index.search(queries, 0).count() == 0 and index.search(queries.limit(0), 5).count() == 0


def test_vector_lists_of_nothing(spark: SparkSession) -> None:
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = VectorIndex.build(none)
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert index.filed.count() == 0 and index.search(queries, 3).count() == 0


def test_centroids() -> None:
    x = np.array([[1.0, 0.0], [2.0, 0.01], [0.0, 1.0], [0.01, 3.0], [-1.0, 0.0]])
    centers = fitted(x, 3)
    assert len(centers) == 3 and np.allclose(np.linalg.norm(centers, axis=1), 1)
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ fitted(x, 5).T
    assert np.allclose(near.max(axis=1), 1, atol=1e-4)
    assert len(fitted(np.ones((5, 2)), 4)) == 1


def shared_words(spark: SparkSession, folder: Path, monkeypatch: pytest.MonkeyPatch, name: str) -> dict[str, int]:
    """How many rows each table has that the query ``name`` stores over 400 documents and 40 queries that share 30 words, so 12,400 postings; its rows are held against its SQL."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"{text} {f'w{i % 11} ' * (i % 5)}x{i}") for i in range(400)] + [(901, "")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"{text} w{i % 30} x{i}") for i in range(40)] + [(70, "unheard")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    sizes: dict[str, int] = {}

    def counted(df: DataFrame, table: str) -> DataFrame:
        out = store.stored(df, table)
        sizes[table] = out.count()
        return out

    def committed(self: SnapshotTable, *a, **b) -> int:
        n = commit(self, *a, **b)
        table = self.path.rpartition("/")[2]
        sizes[table] = max(n, sizes.get(table, 0))
        return n

    def saved(parts: dict[str, DataFrame], path: str) -> None:
        save(parts, path)
        sizes.update({n: spark.read.parquet(f"{path}/{n}").count() for n in parts})

    commit, save = SnapshotTable.commit, readers.save_index
    for module in (sparse, sparse_lists, block_index, live_index, registry, ingest):
        monkeypatch.setattr(module, "stored", counted, raising=False)
    monkeypatch.setattr(SnapshotTable, "commit", committed)
    monkeypatch.setattr(readers, "save_index", saved)
    compare(registry.queries()[name](spark, str(folder)), registry.oracle_sql()[name], str(folder))
    return sizes


@pytest.mark.parametrize("name", ["bounded_topk", "bounded_blocks", "live_index_topk", "bm25_from_index"])
def test_no_posting_is_a_row(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch, name: str) -> None:
    """The largest stored table has a row for each document (and removed one), each query's term or each term."""
    sizes = shared_words(spark, tmp_path, monkeypatch, name)
    assert sizes and max(sizes.values()) <= 40 * 31 + 1


def test_blocks_as_rows(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """The views of the groups are the postings, each in one block, with the greatest impact of its block."""
    monkeypatch.setattr(block_index, "GROUP_DOCS", 4)
    monkeypatch.setattr(block_index, "PACKED", 2)
    docs = frame(spark, passages(6, 90)).repartition(3)
    index = block_index.build_blocks(docs)
    entries = index["blocks"].select("term", "grp", F.inline("entries")).cache()
    shown = lambda df: sorted((r["term"], r["doc_id"], r["tf"], r["dl"]) for r in df.collect())
    assert shown(entries) == shown(sparse.postings(docs))
    avgdl = index["statistics"].first()["avgdl"]
    impact = F.max(F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / avgdl)))
    by = lambda df: sorted((r["term"], r["grp"], round(r["impact"], 9)) for r in df.collect())
    assert by(index["bounds"]) == by(entries.groupBy("term", "grp").agg(impact.alias("impact")))
    assert sorted(r["doc_id"] for r in index["documents"].collect()) == list(range(90))
