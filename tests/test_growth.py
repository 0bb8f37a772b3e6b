"""What grows with the tables: the same results by other ways, and rows that only larger tables have."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators import ingest, late_interaction, sparse, sparse_lists, token_batches
from corvane.plans import registry
from corvane.sources import store
from tests.oracle import compare


def test_the_last_half_second_of_a_week_is_of_that_week(spark: SparkSession, tmp_path: Path) -> None:
    times = [dt.datetime(2024, 1, 3, 23, 59, 59, 700_000), dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 3, 23, 59, 59, 499_999), dt.datetime(1969, 12, 31, 23, 59, 59, 900_000)]
    rows = [(i, t, 1, "click" if i % 2 else "error", 1.0, '{"k": 1}') for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    compare(registry.queries()["feedback_weekly"](spark, str(tmp_path)), registry.oracle_sql()["feedback_weekly"], str(tmp_path))


def words(r: random.Random, n: int) -> str:
    return " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def test_sparse_lists_are_those_of_all_hits(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Block scoring against the scores of joined hits: ties, copies, few hits, negative weights, null and empty texts, queries in parts and documents one at a time."""
    r = random.Random(4)
    docs = [(i, words(r, r.randint(1, 12)) + " the" * (i % 3)) for i in range(90)] + [(200, None), (201, ""), (203, "ñandú the"), *((300 + i, "x y the") for i in range(20))]
    asked = [(i, words(r, r.randint(1, 6)) + " the") for i in range(14)] + [(50, "unheard"), (51, ""), (52, "ñandú x x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    terms = sparse.query_terms(spark.createDataFrame(asked, "query_id long, query string")).cache()
    numbers = ingest.numbered(terms.select("term").distinct(), "term", "no").cache()
    weighted = terms.join(numbers, "term").join(sparse.statistics(df), "term", "left").cache()
    hits = sparse.hits(df, terms).cache()
    shown = lambda rows: sorted((x["query_id"], x["rank"], x["doc_id"], round(x["score"], 6)) for x in rows.collect())
    want = [shown(sparse.search(sparse.bm25_scores(df, terms), df, terms, 7)), shown(sparse.top_k(sparse.dot_from_hits(hits), 7))]
    held = {(x["query_id"], x["doc_id"]): x["count"] for x in hits.groupBy("query_id", "doc_id").count().collect()}
    assert len(want[0]) == 16 * 7 and any(s == 0 for *_, s in want[0])
    for part_terms, cells in ((500_000, 4_000_000), (500_000, 60), (20, 60)):
        monkeypatch.setattr(sparse_lists, "PART_TERMS", part_terms)
        monkeypatch.setattr(sparse_lists, "CELLS", cells)
        found = sparse_lists.lists(sparse_lists.term_counts(df, numbers), weighted, 7).cache()
        assert [shown(found.where("list = 0")), shown(found.where("list = 1").withColumn("score", F.col("dot")))] == want
        assert all(x["held"] == held.get((x["query_id"], x["doc_id"]), 0) for x in found.collect())
    assert sparse_lists.lists(sparse_lists.term_counts(df, numbers), weighted, 0).collect() == []
    assert sparse_lists.lists(sparse_lists.term_counts(df.limit(0), numbers), weighted, 3).collect() == []


def test_document_frequencies_find_the_tokens_of_a_text_once(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """One search for tokens in the plan (of two patterns, one for each kind of text), and counts that brute force gives, with null and empty texts."""
    plans = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store.stored(df, name)

    monkeypatch.setattr(sparse, "stored", kept)
    texts = ["the cat", "The the ñandú dog", None, "", "...", "cat dog x1"]
    got = sparse.statistics(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r["term"]: r["df"] for r in got} == {"the": 2, "cat": 2, "dog": 2, "x1": 1}
    assert {r["avgdl"] for r in got} == {8 / 5}  # ñandú is no token, nor a part of it
    assert len(plans) == 1 and plans[0].count("regexp_extract_all") == 2


def test_tokens_of_a_batch_are_those_of_the_column(spark: SparkSession) -> None:
    """Borders between ASCII and every other kind of character, characters whose small letters are ASCII or longer, texts that end and begin within a run, null and empty texts, slices."""
    r = random.Random(5)
    signs = "aZ9_ .-\n\x00é́ñÀ—“‍‌字İKſ½²ⅷⓐำ‿\ufeff\U0001d400\U0001f600"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(4000)] + [None, "", "", "end"]
    texts += [f"{chr(i)}a b{chr(i)} c {chr(i)} d" for i in (*range(1, 0xD800, 7), *range(0xE000, 0x20000, 7))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("t"), tokens(F.col("t")).alias("want")).toArrow()
    want = [x or [] for x in rows["want"].to_pylist()]
    lowered = rows["t"].combine_chunks()
    for a, n in ((0, len(texts)), (1234, 3000), (4000, 1), (4001, 2), (7, 0)):
        at, words = token_batches.found(lowered.slice(a, n), token_batches.word_characters(spark))
        got = [[] for _ in range(n)]
        for i, w in zip(at.tolist(), words.to_pylist(), strict=True):
            got[i].append(w)
        assert got == want[a : a + n]


def test_lists_read_the_texts_once(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    """One stored table of a search reads documents, where document frequencies took a second pass; frequencies and weights equal those of a pass of their own, over several batches."""
    r = random.Random(6)
    texts = [words(r, r.randint(0, 9)) + f" ñandú x{i % 7}" for i in range(50)] + [None, "", "The the"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a x3 unheard"), (2, "the")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    passes = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        passes.extend([name] if any("documents.parquet" in f for f in df.inputFiles()) else [])
        return store.stored(df, name)

    for module in (registry, sparse, sparse_lists):
        monkeypatch.setattr(module, "stored", kept, raising=False)
    registry._Sparse(spark, str(tmp_path))
    assert passes == ["termcounts"]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    numbers = spark.createDataFrame([("a", 0), ("x3", 1)], "term string, no long")
    shown = lambda rows: sorted((x["term"], x["df"], round(x["idf"], 9), round(x["avgdl"], 9)) for x in rows.collect())
    want = shown(sparse.statistics(df))
    for size in (1000, 4):
        monkeypatch.setattr(sparse_lists, "ROWS", size)
        assert shown(sparse_lists.statistics(sparse_lists.term_counts(df, numbers, vocabulary=True))) == want
    assert shown(sparse_lists.statistics(sparse_lists.term_counts(df.limit(0), numbers, vocabulary=True))) == []


def test_fused_lists_make_no_row_for_a_hit(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    """300 documents and 40 queries that all share 30 words have 360,000 hits; the largest table that the query stores has a row for each document, or k for each query and list."""
    text = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, text) for i in range(40)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = {}

    def counted(df: DataFrame, name: str) -> DataFrame:
        out = store.stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(registry, "stored", counted)
    assert registry.queries()["rrf_fused_topk"](spark, str(tmp_path)).count() == 400
    assert sizes["termcounts"] == 300 and max(sizes.values()) <= 40 * 2 * 100


def rows_stored(spark: SparkSession, folder: Path, monkeypatch: pytest.MonkeyPatch, name: str) -> dict[str, int]:
    """How many rows each table has that the query ``name`` stores over 300 documents and 40 queries which share 30 words, so have 360,000 hits and 12,000 pairs; its rows are held against its SQL."""
    text = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(i, f"{text} {f'w{i % 11} ' * (i % 5)}x{i}") for i in range(300)], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"{text} w{i % 30} w{i % 7}") for i in range(40)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    sizes = {}

    def counted(df: DataFrame, name: str) -> DataFrame:
        out = store.stored(df, name)
        sizes[name] = out.count()
        return out

    for module in (registry, sparse, sparse_lists):
        monkeypatch.setattr(module, "stored", counted, raising=False)
    compare(registry.queries()[name](spark, str(folder)), registry.oracle_sql()[name], str(folder))
    return sizes


def test_method_comparison_makes_no_row_for_a_hit(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    sizes = rows_stored(spark, tmp_path, monkeypatch, "method_comparison")
    assert sizes and max(sizes.values()) <= 40 * 2 * 100


def test_spearman_full_makes_no_row_for_a_hit(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    sizes = rows_stored(spark, tmp_path, monkeypatch, "spearman_full")
    assert sizes and max(sizes.values()) <= 40 * 2 * 100


def test_rrf_k_variants_makes_no_row_for_a_hit(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    sizes = rows_stored(spark, tmp_path, monkeypatch, "rrf_k_variants")
    assert sizes and max(sizes.values()) <= 40 * 2 * 100


def test_passages_are_looked_for_where_their_rarest_token_is(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    """300 documents share 30 words of a passage and two hold it: no row is stored for a document's word; short passages, such without tokens, cut words, case and nulls."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"{text} x{i}") for i in range(300)] + [(400, f"a {text} Rare, end b"), (401, f"{text} Rare, endless"), (402, f"{text} rare, end"), (403, None), (404, "go — — on ñandú go"), (405, "sea wind")]
    asked = [(1, f"{text} Rare, end"), (2, "wind"), (3, "o — — o"), (4, ""), (5, None), (6, "w1 w2 w4"), (7, "n ñandú g"), (8, f"2 {text[6:]}"), (9, "a w0 unheard w2")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = {}

    def counted(df: DataFrame, name: str) -> DataFrame:
        out = store.stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(registry, "stored", counted)
    monkeypatch.setattr(registry.bed, "stored", counted)
    compare(registry.queries()["benchmark_rows"](spark, str(tmp_path)), registry.oracle_sql()["benchmark_rows"], str(tmp_path))
    assert max(sizes.values()) <= 4 * 306
    found = registry._Sparse(spark, str(tmp_path), 3)
    pairs = lambda rows: sorted((x["query_id"], x["doc_id"], x["label"]) for x in rows.collect())
    got = pairs(registry.bed.counted_qrels(spark, str(tmp_path), found.counts, found.asked))
    assert got == sorted((q, i, 1) for q, x in asked for i, y in docs if x is not None and y is not None and x in y) == pairs(registry.bed.qrels(spark, str(tmp_path)))


def test_late_interaction_over_all_lists_joins_no_lists(spark: SparkSession) -> None:
    """With all lists every document is a candidate, and the lists are neither joined nor scored pair by pair; a copy of a document ties by identifier, and more than k of them fill a batch."""
    one = lambda texts: [[[float(ord(w[0]) - 96), float(len(w))] for w in t.split()] for t in texts]
    docs = spark.createDataFrame([(i, "a bb ccc") for i in range(9, 29)] + [(40, "zzz a")], "doc_id long, text string")
    index = late_interaction.TokenIndex.build(late_interaction.token_vectors(docs, "doc_id", one), lists=3)
    index.postings = None
    asked = late_interaction.token_vectors(spark.createDataFrame([(1, "a bb"), (2, "zzz")], "query_id long, query string"), "query_id", one, text="query")
    got = sorted((x["query_id"], x["rank"], x["doc_id"]) for x in index.search(asked, 3, probes=len(index.centers)).collect())
    assert got == [(1, 1, 9), (1, 2, 10), (1, 3, 11), (2, 1, 40), (2, 2, 9), (2, 3, 10)]
