"""The registered queries by name, and the DuckDB SQL that each must equal."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import agreement, analytics, block_index, dense, encode, exploration, flow, fusion, ingest, judge, judge_batches, late_interaction, latency, metrics, monitoring, rerank, sparse, sparse_lists, subwords, vector_index
from corvane.operators.live_index import LiveIndex
from corvane.plans import hooks, oracles
from corvane.plans import testbed as bed
from corvane.sources import readers
from corvane.sources.snapshots import SnapshotTable
from corvane.sources.store import shared_dir, stored
from corvane.streaming import feedback as feedback_stream
from corvane.streaming import streaks as streak_stream

TOP, POOL = 10, 100
SPLIT_DAY = "2024-01-16"
Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# text


@query
def text_tokens_stats(s: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    rows = bed.docs(s, d).select("doc_id", T.let(T.tokens(text), lambda t: F.struct(F.size(t).cast("long").alias("n"), T.stopword_ratio(t).alias("s"))).alias("x"), T.nonascii_ratio(text).alias("a"))
    return rows.select("doc_id", F.col("x.n").alias("n_tokens"), r6("a").alias("nonascii_ratio"), r6("x.s").alias("stopword_ratio"))


@query
def text_mean_sentence_len(s: SparkSession, d: str) -> DataFrame:
    return bed.docs(s, d).select("doc_id", r6(T.mean_sentence_len(F.col("text"))).alias("mean_sent_len"))


@query
def chunk_quality(s: SparkSession, d: str) -> DataFrame:
    return bed.chunk_quality(s, d)


@query
def content_ids(s: SparkSession, d: str) -> DataFrame:
    pages = bed.table(s, d, "pages")
    key = T.document_key(F.col("url"))
    return pages.select("page_id", key.alias("doc_key"), F.sha2("html", 256).alias("content_sha256"), T.chunk_key(key, F.col("page_id"), F.col("html")).alias("chunk_key"))


@query
def snippet(s: SparkSession, d: str) -> DataFrame:
    return bed.docs(s, d).select("doc_id", T.snippet(F.col("text"), 150, "...").alias("snippet"), T.snippet(F.col("text"), 100).alias("short"))


@query
def passage_labels(s: SparkSession, d: str) -> DataFrame:
    """Turns as labelled passages: the label is read back from the assembled part, and what follows it."""
    part = F.concat(F.lit("["), F.col("heading"), F.lit("] "), F.col("text"))
    rows = bed.turns(s, d).select("conv_id", "turn", part.alias("p"))
    return rows.select("conv_id", "turn", T.passage_label(F.col("p")).alias("label"), F.length(T.without_label(F.col("p"))).cast("long").alias("n_chars"))


@query
def request_stages(s: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    return bed.table(s, d, "pages").groupBy(T.request_stage(path).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query
def request_log(s: SparkSession, d: str) -> DataFrame:
    """One row for each page that was asked for: its path, its stage and whether its answer had a body."""
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    return bed.table(s, d, "pages").select("page_id", path.alias("endpoint"), T.request_stage(path).alias("stage"), F.when(F.length("html") > 0, 200).otherwise(500).alias("status_code"))


@query
def footer_query_ids(s: SparkSession, d: str) -> DataFrame:
    """The identifier read back from the footer of a message; the system's messages have none."""
    footer = F.when(F.col("heading") == "system", "").otherwise(F.concat(F.lit("\nquery_id: `c"), F.col("conv_id").cast("string"), F.lit("`")))
    return bed.turns(s, d).select("conv_id", "turn", T.footer_query_id(F.concat("text", footer)).alias("query_id"))


@query
def tracked_reactions(s: SparkSession, d: str) -> DataFrame:
    """Events as reactions by name: only the two tracked ones count."""
    name = F.when(F.col("stage") == "click", "thumbsup").when(F.col("stage") == "error", "thumbsdown").otherwise("eyes")
    rows = bed.events(s, d).select(T.reaction(name).alias("reaction")).where("reaction is not null")
    return rows.groupBy("reaction").agg(F.count(F.lit(1)).alias("n"))


@query
def search_tab_context(s: SparkSession, d: str) -> DataFrame:
    """The context of each conversation: its first three turns as passages, in order."""
    lists = bed.turns(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("turn").alias("chunk_id"), "text"))).alias("p"))
    return lists.select("conv_id", F.sha2(T.context(F.slice("p", F.lit(1), F.lit(3))), 256).alias("context_sha256"))


# ingestion


@query
def doc_assembly_offsets(s: SparkSession, d: str) -> DataFrame:
    rows = ingest.page_offsets(bed.turns(s, d), doc="conv_id", page="turn")
    return rows.select("conv_id", "turn", "char_offset", F.length("part").cast("long").alias("part_chars"))


@query
def doc_assembly_text(s: SparkSession, d: str) -> DataFrame:
    rows = ingest.assembled(ingest.page_offsets(bed.turns(s, d), doc="conv_id", page="turn"), doc="conv_id", page="turn")
    return rows.select("conv_id", F.sha2("full_text", 256).alias("sha256"), F.length("full_text").cast("long").alias("n_chars"))


@query
def nearest_heading(s: SparkSession, d: str) -> DataFrame:
    """For the middle of each turn the last user turn's first word at or before it."""
    rows = ingest.page_offsets(bed.turns(s, d), doc="conv_id", page="turn")
    word = F.when(F.col("heading") == "user", F.regexp_extract("text", r"(\S+)", 1)).otherwise("")
    heads = rows.select("conv_id", F.col("char_offset").alias("offset"), word.alias("heading"))
    places = rows.select("conv_id", "turn", (F.col("char_offset") + F.floor(F.length("part") / 2)).cast("long").alias("pos"))
    return ingest.nearest_heading(places, heads, doc="conv_id").select("conv_id", "turn", "pos", "heading")


@query
def chunk_split(s: SparkSession, d: str) -> DataFrame:
    rows = ingest.chunk_documents(bed.docs(s, d), text="text")
    return rows.select("doc_id", "chunk_index", "pos", F.length("chunk_text").cast("long").alias("n_chars"), "chunk_id", "token_count")


@query
def chunk_subwords(s: SparkSession, d: str) -> DataFrame:
    """Each chunk's number of byte-pair tokens."""
    import public_tokenizers as vocabulary  # a file beside the engine, so the other queries do without it

    chunks = ingest.chunk_documents(bed.docs(s, d), text="text").select("doc_id", "chunk_index", "chunk_text")
    return subwords.token_counts(chunks, subwords.ranks_of(vocabulary.path("byte_bpe_50k.tiktoken")), vocabulary.PATTERN, text="chunk_text").drop("chunk_text")


@query
def vector_positions(s: SparkSession, d: str) -> DataFrame:
    """Every document's place in the vector collection, in the order of identifiers."""
    return ingest.numbered(bed.docs(s, d).select("doc_id"), "doc_id", "vec_id")


@query
def chunk_emission(s: SparkSession, d: str) -> DataFrame:
    """The pieces of assembled conversations with the heading that each begins under."""
    parts = ingest.page_offsets(bed.turns(s, d), doc="conv_id", page="turn")
    texts = ingest.assembled(parts, doc="conv_id", page="turn")
    rows = ingest.emitted_chunks(texts, parts.select("conv_id", F.col("char_offset").alias("offset"), "heading"), doc="conv_id")
    return rows.select("conv_id", "chunk_index", "chunk_id", "token_count", "section_heading", F.length("chunk_text").cast("long").alias("n_chars"))


@query
def download_report(s: SparkSession, d: str) -> DataFrame:
    """Every document is on the manifest; labelled ones have a file, which is right if their quality is 1."""
    files = bed.table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("is_pdf"))
    return ingest.download_report(bed.docs(s, d), files, "doc_id")


@query
def vector_upsert(s: SparkSession, d: str) -> DataFrame:
    """Stored: the English documents; incoming: all, with the length of their source's name."""
    rows = bed.table(s, d, "documents").select("doc_id", "lang", F.length("source").cast("long").alias("payload"))
    old = ingest.numbered(rows.where("lang = 'en'").select("doc_id", F.lit(None).cast("long").alias("payload")), "doc_id", "vec_id")
    return ingest.upsert_vectors(old, rows.drop("lang"), "doc_id")


@query
def upsert_quality(s: SparkSession, d: str) -> DataFrame:
    """Stored: a score of 0 for every labelled document; incoming: the measured ones."""
    old = bed.table(s, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.lit(0.0).alias("quality_score"), F.lit(True).alias("flagged")).distinct()
    return ingest.upsert(old, bed.chunk_quality(s, d).select("chunk_id", "quality_score", "flagged"), "chunk_id")


@query
def upsert_docs(s: SparkSession, d: str) -> DataFrame:
    """Stored: the labels; incoming: every document with a quality of its own, or null where its text has no line break."""
    stored = bed.table(s, d, "labels").select("doc_id", F.col("quality").cast("long").alias("content"))
    incoming = bed.docs(s, d).select("doc_id", F.when(F.contains("text", F.lit("\n")), F.length("text").cast("long")).alias("content"))
    return ingest.upsert(stored, incoming, "doc_id")


@query
def insert_if_absent(s: SparkSession, d: str) -> DataFrame:
    return ingest.insert_if_absent(bed.table(s, d, "labels"), bed.docs(s, d).select("doc_id"), "doc_id")


@query
def hash_drift(s: SparkSession, d: str) -> DataFrame:
    """Documents whose text differs from its trimmed, single-spaced form."""
    rows = bed.docs(s, d)
    stored = rows.select("doc_id", F.sha2("text", 256).alias("h"))
    return ingest.hash_drift(stored, rows.select("doc_id", F.sha2(F.trim(F.replace("text", F.lit("\n"), F.lit(" "))), 256).alias("h")), "doc_id", "h")


@query
def feedback_fk_repair(s: SparkSession, d: str) -> DataFrame:
    log = bed.queries(s, d).select(F.col("query_id").cast("string").alias("query_id"))
    rows = bed.feedback(s, d).select("event_id", "query_id", F.lit(None).cast("string").alias("source"), F.nullif("user_id", F.lit("0")).alias("user_id"), "reaction")
    return ingest.repaired_feedback(rows, log)


@query
def coverage(s: SparkSession, d: str) -> DataFrame:
    return ingest.coverage(bed.docs(s, d), bed.table(s, d, "labels"), "doc_id")


@query
def coverage_missing(s: SparkSession, d: str) -> DataFrame:
    return ingest.missing(bed.docs(s, d), bed.table(s, d, "labels"), "doc_id")


@query
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """Rows of each source in a sample of 200, with every toxic document."""
    forced = bed.table(s, d, "labels").where("toxic = 1").select("doc_id").distinct()
    got = ingest.stratified_sample(bed.table(s, d, "documents").select("doc_id", "source"), forced, 200, "source", "doc_id")
    return got


# retrieval


class _Sparse:
    """The given queries' first documents by BM25 and by dot product, found in one pass and stored, and the lists that follow from them."""

    def __init__(self, s: SparkSession, d: str, k: int = POOL, weighted: bool = True) -> None:
        docs, self.terms = bed.docs(s, d), stored(sparse.query_terms(bed.queries(s, d)), "terms")
        numbers = stored(ingest.numbered(self.terms.select("term").distinct(), "term", "no"), "termnumbers")
        self.counts = stored(sparse_lists.term_counts(docs, numbers, vocabulary=weighted), "termcounts")
        idf = sparse_lists.statistics(self.counts) if weighted else s.createDataFrame([], "term string, df long, idf double, avgdl double")
        self.asked = stored(self.terms.join(numbers, "term").join(idf, "term", "left"), "askedterms")
        self.found = stored(sparse_lists.lists(self.counts, self.asked, k), "lists")

    def bm25(self, k: int = TOP) -> DataFrame:
        return self.found.where((F.col("list") == sparse_lists.BM25) & (F.col("rank") <= k)).select("query_id", "doc_id", "score", "rank")

    def dots(self, k: int = POOL) -> DataFrame:
        return self.found.where((F.col("list") == sparse_lists.DOT) & (F.col("rank") <= k)).select("query_id", "doc_id", F.col("dot").alias("score"), "rank")

    def fused(self, k: int = fusion.RRF_K, n: int = TOP) -> DataFrame:
        return fusion.rrf([self.bm25(POOL), self.dots(POOL)], n, k)

    def pairs(self) -> DataFrame:
        """query_id, doc_id, dot, held of every document of either list."""
        return self.found.select("query_id", "doc_id", "dot", "held").dropDuplicates(["query_id", "doc_id"])

    def overlap(self, pool: DataFrame) -> DataFrame:
        """``pool``, of documents of either list, with the share of the query's distinct tokens that each document holds."""
        sizes = self.terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_terms"))
        held = self.pairs().join(sizes, "query_id").select("query_id", "doc_id", (F.col("held") / F.col("_terms")).alias("overlap"))
        return pool.join(held, ["query_id", "doc_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def _bm25(s: SparkSession, d: str, k: int = TOP) -> DataFrame:
    return _Sparse(s, d, k).bm25(k)


def _dot(s: SparkSession, d: str, k: int = TOP) -> DataFrame:
    return _Sparse(s, d, k, weighted=False).dots(k)


def _dense(s: SparkSession, d: str, k: int = TOP) -> DataFrame:
    return dense.cosine_top_k(bed.vectors(s, d), bed.vector_queries(s, d), k, doc_id="vec_id")


def _fused(s: SparkSession, d: str, k: int = fusion.RRF_K, n: int = TOP) -> DataFrame:
    return _Sparse(s, d).fused(k, n)


@query
def bm25_term_stats(s: SparkSession, d: str) -> DataFrame:
    return _rounded(sparse.term_stats(bed.docs(s, d)), "idf")


@query
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_bm25(s, d), "score")


@query
def bm25_from_index(s: SparkSession, d: str) -> DataFrame:
    """As ``bm25_topk``, from an index that was saved and loaded."""
    path = f"{shared_dir(s)}/corvane-index-{uuid.uuid4().hex}"
    readers.save_index({"postings": sparse_lists.packed(bed.docs(s, d))}, path)
    readers.save_index({"statistics": sparse_lists.packed_statistics(readers.load_index(s, path, ["postings"])["postings"])}, path)
    index = readers.load_index(s, path, ["postings", "statistics"])
    return _rounded(sparse_lists.search(index["postings"], index["statistics"], sparse.query_terms(bed.queries(s, d)), TOP), "score")


@query
def bounded_topk(s: SparkSession, d: str) -> DataFrame:
    """As ``bm25_topk``, from blocks of postings of which only those that can reach the list are read."""
    return _rounded(block_index.bounded_top_k(block_index.build_blocks(bed.docs(s, d)), bed.queries(s, d), TOP), "score")


@query
def bounded_blocks(s: SparkSession, d: str) -> DataFrame:
    """How many blocks the queries' terms have, and whether the search read fewer."""
    got = block_index.blocks_read(block_index.build_blocks(bed.docs(s, d)), bed.queries(s, d), TOP)
    return got.select((F.col("read") > 0).alias("some_read"), (F.col("read") < F.col("blocks")).alias("some_skipped"))


@query
def live_index_topk(s: SparkSession, d: str) -> DataFrame:
    """As ``bm25_topk``, from an index that came to the given documents by changes: it began without a third of them, with shortened texts of some and with documents that are gone now."""
    docs = bed.docs(s, d)
    index = LiveIndex(s, f"{shared_dir(s)}/corvane-live-{uuid.uuid4().hex}", dict(docs.dtypes)["doc_id"])
    old = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 200)).otherwise(F.col("text")).alias("text"))
    index.apply(old.unionByName(docs.where("doc_id % 7 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "text")), name="first")
    index.apply(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 14 = 0").select((-1 - F.col("doc_id")).alias("doc_id")), name="inserts")
    index.compact()
    index.apply(docs.where("doc_id % 5 = 0"), docs.where("doc_id % 14 = 7").select((-1 - F.col("doc_id")).alias("doc_id")), name="updates")
    return _rounded(index.search(bed.queries(s, d), TOP), "score")


@query
def sparse_dot_topk(s: SparkSession, d: str) -> DataFrame:
    return _dot(s, d)


@query
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_dense(s, d), "score")


@query
def vector_index_exact(s: SparkSession, d: str) -> DataFrame:
    """As ``dense_topk``, from inverted lists that are all looked into."""
    index = vector_index.VectorIndex.build(bed.vectors(s, d))
    return _rounded(index.search(bed.vector_queries(s, d), TOP, probes=len(index.centers)), "score")


@query
def vector_index_recall(s: SparkSession, d: str) -> DataFrame:
    """The queries, and whether the lists nearest to each hold nine tenths of all true neighbours."""
    index = vector_index.VectorIndex.build(bed.vectors(s, d))
    got = vector_index.recall(index.search(bed.vector_queries(s, d), TOP), _dense(s, d), doc_id="vec_id")
    return got.select("queries", "wanted", (F.col("recall") >= 0.9).alias("reached"))


@query
def vector_index_topk(s: SparkSession, d: str) -> DataFrame:
    """What the lists nearest to each query give."""
    return _rounded(vector_index.VectorIndex.build(bed.vectors(s, d)).search(bed.vector_queries(s, d), TOP), "score")


@query
def collection_stats(s: SparkSession, d: str) -> DataFrame:
    return dense.collection_stats(bed.vectors(s, d))


@query
def rrf_fused_topk(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_fused(s, d), "score")


def _hashed(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for a dense model: how many tokens have each of 16 remainders of length and first letter."""
    out = []
    for text in texts:
        v = [0.0] * 16
        for t in re.findall(r"(?<!\w)[a-z0-9_]+(?!\w)", text.lower()):
            v[(len(t) + ord(t[0])) % 16] += 1.0
        out.append(v)
    return out


@query
def hybrid_dense_topk(s: SparkSession, d: str) -> DataFrame:
    """BM25 fused with the dense lists of encoded documents and queries, pools of 100 from each."""
    vectors = stored(encode.dense_vectors(bed.docs(s, d), "doc_id", _hashed), "docvectors")
    asked = encode.dense_vectors(bed.queries(s, d), "query_id", _hashed, text="query")
    return _rounded(fusion.rrf([_bm25(s, d, POOL), dense.cosine_top_k(vectors, asked, POOL)], TOP), "score")


@query
def rrf_k_variants(s: SparkSession, d: str) -> DataFrame:
    found = _Sparse(s, d)
    a, b = found.bm25(POOL), found.dots(POOL)
    out = [fusion.rrf([a, b], 5, k).select(F.lit(k).cast("long").alias("k"), "query_id", "doc_id", "rank") for k in (10, 60)]
    return out[0].unionByName(out[1])


@query
def method_comparison(s: SparkSession, d: str) -> DataFrame:
    """The first three of each method with the method's name."""
    found = _Sparse(s, d)
    a, b = found.bm25(POOL), found.dots(POOL)
    lists = {"bm25": a, "dot": b, "rrf": fusion.rrf([a, b], POOL)}
    out = None
    for name, x in lists.items():
        part = x.where("rank <= 3").select(F.lit(name).alias("method"), "query_id", "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


@query
def method_comparison_snippets(s: SparkSession, d: str) -> DataFrame:
    """``method_comparison`` with the first 80 characters of each text."""
    rows = method_comparison(s, d).join(bed.docs(s, d), "doc_id")
    return rows.select("method", "query_id", "doc_id", "rank", T.snippet(F.col("text"), 80).alias("snippet"))


@query
def method_overlap(s: SparkSession, d: str) -> DataFrame:
    found = _Sparse(s, d)
    return fusion.overlap(found.bm25(POOL), found.dots(POOL), 5)


@query
def top1_pairs(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d, n=1).select("query_id", "doc_id")


def _with_texts(s: SparkSession, d: str, pool: DataFrame) -> DataFrame:
    return pool.join(bed.docs(s, d), "doc_id").join(bed.queries(s, d), "query_id")


@query
def rerank_scored(s: SparkSession, d: str) -> DataFrame:
    """The fused pool re-ranked by the share of the query's distinct tokens that a document holds."""
    found = _Sparse(s, d)
    pool = found.overlap(found.fused(n=POOL))
    got = rerank.routed(pool, "live_fast", {"live_fast": lambda query, text: F.col("overlap")}, 5)
    return _rounded(got.select("query_id", "doc_id", "score", "rank", "tier"), "score")


@query
def rerank_fallback(s: SparkSession, d: str) -> DataFrame:
    return _rounded(rerank.fallback(_fused(s, d, n=POOL), 5), "score")


@query
def rerank_rank1(s: SparkSession, d: str) -> DataFrame:
    """The first document before and after re-ranking, by query."""
    found = _Sparse(s, d)
    fused = stored(found.fused(n=POOL), "pool")
    after = rerank.by_score(found.overlap(fused), F.col("overlap"), 1).select("query_id", F.col("doc_id").alias("after_id"))
    before = fused.where("rank = 1").select("query_id", F.col("doc_id").alias("before_id"))
    return before.join(after, "query_id").withColumn("moved", F.col("before_id") != F.col("after_id"))


# metrics and benchmark


@query
def dense_metrics(s: SparkSession, d: str) -> DataFrame:
    got = metrics.labelled_metrics(bed.vector_labels(s, d, _dense(s, d)), bed.vector_counts(s, d), doc_id="vec_id")
    return _rounded(got, "ndcg", "ndcg_exp", "mrr", "prec_at_3", "prec_at_5", "prec_at_10")


def _benchmark(s: SparkSession, d: str) -> DataFrame:
    found = _Sparse(s, d, TOP)
    lists = {"A": found.bm25(), "C": found.dots(TOP)}
    a, c = (x.select(F.lit(n).alias("config"), "query_id", "doc_id", "rank") for n, x in lists.items())
    ranked = a.unionByName(c)
    return metrics.benchmark_rows(ranked, bed.counted_qrels(s, d, found.counts, found.asked), {"C": 0.002})


@query
def benchmark_rows(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_benchmark(s, d), *metrics.MEANS)


@query
def benchmark_aggregate(s: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.aggregate(_benchmark(s, d)), *metrics.MEANS, "cost_usd")


@query
def ndcg_gate(s: SparkSession, d: str) -> DataFrame:
    return metrics.gate(metrics.aggregate(_benchmark(s, d)), 0.30)


@query
def ndcg_quartiles(s: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.spread(_benchmark(s, d)), "p25", "p50", "p75", "mean")


@query
def model_winner(s: SparkSession, d: str) -> DataFrame:
    return metrics.winner(metrics.aggregate(_benchmark(s, d)), expected=2)


def _ranks(s: SparkSession, d: str) -> DataFrame:
    """Two orderings of each query's fused pool: as fused, and by the dot product."""
    found = _Sparse(s, d)
    a = stored(found.fused(n=POOL), "pool")
    order = Window.partitionBy("query_id").orderBy(F.desc("dot"), "doc_id")
    c = a.join(found.pairs(), ["query_id", "doc_id"]).withColumn("rank", F.row_number().over(order).cast("long"))
    return agreement.both_ranks(a, c)


@query
def spearman_full(s: SparkSession, d: str) -> DataFrame:
    return _rounded(agreement.spearman_full(_ranks(s, d)), "rho")


@query
def spearman_head(s: SparkSession, d: str) -> DataFrame:
    return _rounded(agreement.spearman_head(_ranks(s, d)), "rho")


@query
def overlap_at_n(s: SparkSession, d: str) -> DataFrame:
    return agreement.overlaps(_ranks(s, d))


@query
def rbo(s: SparkSession, d: str) -> DataFrame:
    return _rounded(agreement.rbo(_ranks(s, d)), "rbo")


@query
def agreement_by_case(s: SparkSession, d: str) -> DataFrame:
    """Mean agreement by case; a query's case is the length of its passage in hundreds of characters."""
    ranks = _ranks(s, d)
    case = bed.queries(s, d).select("query_id", F.floor(F.length("query") / 100).cast("long").alias("case_no"))
    rows = agreement.spearman_full(ranks).join(agreement.rbo(ranks), "query_id").join(case, "query_id")
    return _rounded(agreement.by_case(rows, "case_no", ["rho", "rbo"]), "rho", "rbo")


@query
def agreement_summary(s: SparkSession, d: str) -> DataFrame:
    return _rounded(agreement.summary(agreement.rbo(_ranks(s, d)), "rbo"), "mean", "median", "least", "greatest")


@query
def agreement_gap(s: SparkSession, d: str) -> DataFrame:
    """In how many queries rank-biased overlap is above the correlation, and the mean gap."""
    ranks = _ranks(s, d)
    rows = agreement.spearman_full(ranks).join(agreement.rbo(ranks), "query_id")
    return _rounded(agreement.gap(rows, "rbo", "rho"), "mean_gap")


# encoders, retrieval node, fixed query set


def _weights(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sparse vectors of documents and queries: log(1 + count) of each token."""
    return encode.sparse_vectors(bed.docs(s, d), "doc_id"), encode.sparse_vectors(bed.queries(s, d), "query_id", "query")


@query
def splade_dot_topk(s: SparkSession, d: str) -> DataFrame:
    docs, asked = _weights(s, d)
    return _rounded(encode.sparse_top_k(docs, asked, TOP), "score")


@query
def splade_pooled(s: SparkSession, d: str) -> DataFrame:
    """Weights pooled from the logits of a stand-in model: each token raises itself by half its length less 2, and its first three letters by its length less 6; tokens of one letter are masked."""
    toks = bed.docs(s, d).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("position", "t")).withColumn("mask", F.when(F.length("t") > 1, 1).otherwise(0))
    raised = F.array(F.struct(F.col("t").alias("term"), (F.length("t") / 2 - 2).alias("logit")), F.struct(F.substring("t", 1, 3).alias("term"), (F.length("t") - 6).cast("double").alias("logit")))
    logits = toks.select("doc_id", "position", "mask", F.inline(raised))
    return _rounded(encode.pooled(logits, "doc_id"), "weight")


def _token_digests(texts: list[str]) -> list[list[list[float]]]:
    """A deterministic stand-in for a token encoder: four bytes of each token's digest."""
    out = []
    for text in texts:
        found = (hashlib.md5(t.encode()).digest() for t in re.findall(r"(?<!\w)[a-z0-9_]+(?!\w)", text.lower()))
        out.append([[b - 127.5 for b in x[:4]] for x in found])
    return out


@query
def late_interaction_topk(s: SparkSession, d: str) -> DataFrame:
    """Documents by the sum of each query token's greatest product with one of their tokens, from all lists."""
    index = late_interaction.TokenIndex.build(late_interaction.token_vectors(bed.docs(s, d), "doc_id", _token_digests))
    asked = late_interaction.token_vectors(bed.queries(s, d), "query_id", _token_digests, text="query")
    return _rounded(index.search(asked, TOP, probes=len(index.centers)), "score")


@query
def prefixed_queries(s: SparkSession, d: str) -> DataFrame:
    """Queries and passages as the default model wants them."""
    rows = bed.queries(s, d).select("query_id", encode.prefixed(F.col("query"), "query").alias("q"), encode.prefixed(F.col("query"), "passage").alias("p"))
    return rows.select("query_id", F.sha2("q", 256).alias("query_sha256"), F.sha2("p", 256).alias("passage_sha256"))


@query
def retrieve_without_dense(s: SparkSession, d: str) -> DataFrame:
    """The retrieval node where no dense retriever is set."""
    state = flow.retrieve(lambda: _bm25(s, d, POOL), None, TOP)
    return _rounded(state.fused.select("query_id", "doc_id", "score", "rank"), "score")


@query
def first_queries(s: SparkSession, d: str) -> DataFrame:
    """The first queries of the benchmark's set, numbered."""
    return flow.first_queries(bed.queries(s, d), 10)


@query
def pool_labels(s: SparkSession, d: str) -> DataFrame:
    """Every pair of a query and a pooled document, labelled 1 where the document holds the passage."""
    pairs = _with_texts(s, d, _fused(s, d))
    return judge.label_pool(pairs, F.contains("text", "query").cast("int")).select("query_id", "doc_id", "label")


@query
def biencoder_mean(s: SparkSession, d: str) -> DataFrame:
    """Mean exponential NDCG of the vectors' own ranking."""
    return dense_metrics(s, d).agg(r6(F.avg("ndcg_exp")).alias("mean_ndcg"), F.count(F.lit(1)).alias("num_queries"))


# catalogue analytics


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"docs": bed.metadata(s, d), "chunks": bed.chunks(s, d), "quality": bed.chunk_quality(s, d)}


@query
def count_by_family(s: SparkSession, d: str) -> DataFrame:
    return analytics.dispatch(_tables(s, d), "count_docs_by_gpu_family", {})


@query
def below_threshold(s: SparkSession, d: str) -> DataFrame:
    return analytics.dispatch(_tables(s, d), "chunks_below_quality_threshold", {"threshold": "0.6"})


@query
def avg_quality_per_doc(s: SparkSession, d: str) -> DataFrame:
    return analytics.dispatch(_tables(s, d), "avg_quality_per_doc", {})


@query
def chunk_count_like(s: SparkSession, d: str) -> DataFrame:
    return analytics.dispatch(_tables(s, d), "chunk_count_for_doc", {"title_fragment": "SRC1"})


@query
def list_docs(s: SparkSession, d: str) -> DataFrame:
    return analytics.dispatch(_tables(s, d), "list_indexed_documents", {})


@query
def avg_price_per_nation(s: SparkSession, d: str) -> DataFrame:
    """The catalogue's three-way join and average over the order tables."""
    line, supplier, nation = (bed.table(s, d, t) for t in ("lineitem", "supplier", "nation"))
    rows = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(analytics.exact_mean("l_extendedprice", 4).alias("avg_price"), F.count(F.lit(1)).alias("lines"))


@query
def eda_canned(s: SparkSession, d: str) -> DataFrame:
    """Two of the three canned questions: share supported, the day of the largest value (the third, the mean by config, is ``eda_mean_by_config``)."""
    day = bed.daily(s, d).groupBy("day").agg(F.max("score").alias("m")).agg(F.max_by("day", F.struct("m", "day")).alias("worst_day"))
    share = judge.accuracy(bed.judgments(s, d))
    return share.crossJoin(day).select(r6("citation_accuracy").alias("citation_accuracy"), F.col("worst_day").cast("string").alias("worst_day"))


@query
def eda_mean_by_config(s: SparkSession, d: str) -> DataFrame:
    rows = _benchmark(s, d).groupBy("config").agg(F.avg("ndcg_at_10").alias("mean_ndcg"), F.avg("mrr").alias("mean_mrr"))
    return _rounded(rows, "mean_ndcg", "mean_mrr")


@query
def eda_views(s: SparkSession, d: str) -> DataFrame:
    """A question in SQL over the views that could be loaded: the best query of each config, with the number of sources that failed."""
    def lost() -> DataFrame:
        raise FileNotFoundError("no such source")

    failed = exploration.register_views({"benchmark_eda": lambda: exploration.benchmark_view(_benchmark(s, d)), "lost_eda": lost, "judged_eda": lambda: bed.judgments(s, d)})
    best = "(SELECT config, max(ndcg_at_10) AS ndcg_at_10, count(latency_ms) AS timed FROM benchmark_eda GROUP BY config)"
    return s.sql(f"SELECT config, round(ndcg_at_10, 6) AS ndcg_at_10, timed, (SELECT count(*) FROM judged_eda WHERE supported) AS supported, {len(failed)} AS failed FROM {best}")


@query
def orchestrated_run(s: SparkSession, d: str) -> DataFrame:
    """All steps in one run: BM25 and dot products fused, re-ranked by overlap, each of the first five results cited for the passage, judged by whether it holds it."""
    found = _Sparse(s, d)
    queries = bed.queries(s, d)

    def generate(passages: DataFrame) -> DataFrame:
        return passages.join(queries, "query_id").groupBy("query_id", F.col("query").alias("claim")).agg(F.collect_list("doc_id").alias("chunk_ids"))

    def reranked(rows: DataFrame) -> DataFrame:
        return rerank.by_score(found.overlap(rows), F.col("overlap"), POOL)

    state = flow.orchestrate(lambda: found.bm25(POOL), lambda: found.dots(POOL), reranked, generate, bed.docs(s, d), F.contains("text", "claim"), POOL, 5)
    if state.error:
        raise RuntimeError(state.error)
    return state.judgments.groupBy("query_id").agg(F.count_if("supported").alias("supported"), F.count(F.lit(1)).alias("total"))


@query
def contexts_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The first three fused results of each query with their texts, saved and read back."""
    path = f"{shared_dir(s)}/corvane-contexts-{uuid.uuid4().hex}"
    rows = _with_texts(s, d, _fused(s, d, n=3)).withColumnRenamed("doc_id", "chunk_id")
    readers.write_contexts(rows, path)
    got = readers.contexts(s, path)
    return got.select(F.col("query_id").cast("long").alias("query_id"), F.col("chunk_id").cast("long").alias("doc_id"), r6("score").alias("score"), F.col("rank").cast("long").alias("rank"), F.sha2("text", 256).alias("text_sha256"))


@query
def latest_citation_run(s: SparkSession, d: str) -> DataFrame:
    """The value of the newest run alone, null if it has none; only some events count as runs with a value."""
    rows = bed.events(s, d).withColumn("metric", F.when(F.col("stage") == "view", F.col("duration_ms")))
    return analytics.newest(rows, "ts", "metric", "event_id").select("metric")


@query
def latest_run_per_config(s: SparkSession, d: str) -> DataFrame:
    got = analytics.latest_by(bed.events(s, d), "user_id", "ts", "duration_ms", "event_id")
    return got.select("user_id", F.col("ts").cast("string").alias("ts"), "duration_ms")


@query
def latest_complete(s: SparkSession, d: str) -> DataFrame:
    rows = bed.events(s, d).withColumn("second", F.when(F.col("stage") != "view", F.col("duration_ms")))
    got = analytics.latest_complete(rows, "ts", ["duration_ms", "second"], "event_id")
    return got.select(F.col("ts").cast("string").alias("ts"), "duration_ms", "second")


@query
def stage_latency(s: SparkSession, d: str) -> DataFrame:
    return _rounded(analytics.stage_latency(bed.events(s, d)), "p50", "p95")


@query
def daily_error_rate(s: SparkSession, d: str) -> DataFrame:
    rows = bed.events(s, d).withColumn("is_error", F.col("stage") == "error").withColumn("day", F.col("day").cast("string"))
    return analytics.daily_error_rate(rows, "day", "is_error")


@query
def relevance_pct(s: SparkSession, d: str) -> DataFrame:
    return analytics.relevance_percent(_dot(s, d)).select("query_id", "doc_id", "percent")


# monitoring


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = bed.vectors(s, d)
    return v.where("label < 5"), v.where("label >= 5")


def _windows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = bed.turns(s, d)
    return c.where("heading = 'user'").select("text"), c.where("heading = 'assistant'").select("text")


@query
def centroid_projection(s: SparkSession, d: str) -> DataFrame:
    base, _ = _halves(s, d)
    return _rounded(dense.project(bed.vectors(s, d).select("vec_id", "embedding"), dense.centroid(base)).select("vec_id", "x"), "x")


@query
def psi_embeddings(s: SparkSession, d: str) -> DataFrame:
    return _rounded(monitoring.guarded_drift(*_halves(s, d)), "psi")


@query
def psi_values(s: SparkSession, d: str) -> DataFrame:
    e = bed.events(s, d)
    got = monitoring.psi(e.where(F.col("day") < SPLIT_DAY), e.where(F.col("day") >= SPLIT_DAY), "duration_ms")
    return _rounded(got.withColumn("severity", monitoring.severity(F.col("psi"))), "psi")


@query
def term_freq(s: SparkSession, d: str) -> DataFrame:
    return _rounded(monitoring.term_frequencies(bed.docs(s, d)).withColumn("freq", F.col("freq") * 1000), "freq")


@query
def term_shift(s: SparkSession, d: str) -> DataFrame:
    """Terms whose share differs between languages: English against all others."""
    docs = bed.table(s, d, "documents")
    got = monitoring.top_shifts(monitoring.term_shift(docs.where("lang = 'en'"), docs.where("lang <> 'en'"), 0.005))
    return _rounded(got, "base_freq", "cur_freq", "delta")


@query
def new_terms(s: SparkSession, d: str) -> DataFrame:
    return monitoring.new_terms(*_windows(s, d))


@query
def dropped_terms(s: SparkSession, d: str) -> DataFrame:
    return monitoring.new_terms(*_windows(s, d)[::-1])


@query
def decline_streak(s: SparkSession, d: str) -> DataFrame:
    got = monitoring.streaks(bed.daily(s, d))
    return got.select("metric", "streak", "latest", F.col("day").cast("string").alias("day"), "regressing")


@query
def streak_closed(s: SparkSession, d: str) -> DataFrame:
    """As ``decline_streak``, from a stream of the daily scores in two runs of which the second goes on where the first stopped; a last row far ahead closes all days."""
    base = f"{shared_dir(s)}/corvane-streaks-{uuid.uuid4().hex}"
    rows = bed.daily(s, d).select("metric", F.col("day").cast("timestamp").alias("ts"), "score")
    end = s.range(1).select(F.lit("(end)").alias("metric"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(0.0).alias("score"))
    for part in (rows.where(F.col("ts") < SPLIT_DAY), rows.where(F.col("ts") >= SPLIT_DAY).unionByName(end)):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = s.readStream.schema(part.schema).parquet(f"{base}/in")
        streak_stream.start(streak_stream.streaks(stream), f"{base}/out", f"{base}/state").awaitTermination()
    found = streak_stream.latest(s.read.schema(streak_stream.OUT).parquet(f"{base}/out"))
    return found.select("metric", "streak", "latest", F.col("day").cast("string").alias("day"), "regressing")


@query
def stage_counts(s: SparkSession, d: str) -> DataFrame:
    """What the hooks of three stages were told: all documents, the flagged ones, and their characters."""
    told: list[tuple[str, int, int]] = []
    stages = hooks.Stages(s, persist=lambda stage, m: told.append((stage, int(m["rows"]), int(m["size"] or 0))))
    size = {"size": F.sum(F.length("text"))}
    docs = stages.run("scan", bed.docs(s, d), size)
    scored = stages.run("quality", docs.withColumn("q", T.quality(F.col("text"))), size)
    stages.run("flagged", scored.where("q.flagged"), size)
    return s.createDataFrame(told, "stage string, n long, size long")


@query
def regression_alert(s: SparkSession, d: str) -> DataFrame:
    return monitoring.regression_alert(monitoring.streaks(bed.daily(s, d), alert=1))


@query
def feedback_summary(s: SparkSession, d: str) -> DataFrame:
    return monitoring.feedback_summary(bed.feedback(s, d))


@query
def worst_queries(s: SparkSession, d: str) -> DataFrame:
    return monitoring.worst_queries(bed.feedback(s, d))


@query
def feedback_weekly(s: SparkSession, d: str) -> DataFrame:
    rows = bed.feedback(s, d).withColumn("created_at", F.col("ts").cast("timestamp"))
    got = feedback_stream.weekly(rows)
    return got.select(F.col("week_start").cast("string").alias("week_start"), "total", "up", "down", "down_rate", "alert")


NOW = "2024-01-31"


@query
def drift_windows(s: SparkSession, d: str) -> DataFrame:
    """How many values, and their mean, in the baseline's and the current window before a fixed day."""
    base, cur = monitoring.drift_windows(bed.events(s, d), "ts", NOW, (30, 23, 2))
    parts = [x.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("duration_ms")).alias("mean")).select(F.lit(name).alias("window"), "n", "mean") for name, x in (("baseline", base), ("current", cur))]
    return parts[0].unionByName(parts[1])


@query
def feedback_trailing_week(s: SparkSession, d: str) -> DataFrame:
    return monitoring.feedback_summary(monitoring.trailing(bed.feedback(s, d), "ts", NOW, 7))


@query
def regression_run(s: SparkSession, d: str) -> DataFrame:
    """The last day's scores of the first 20 queries, appended to the history before it."""
    last = "2024-01-30"
    history = bed.daily(s, d).where(F.col("day") < last)
    today = bed.events(s, d).where(F.col("day") == last).select(F.col("stage").alias("metric"), "query_id", "day", F.col("duration_ms").alias("score"))
    found = monitoring.regression_run(history, today, 20)
    return found.select("metric", "streak", r6("latest").alias("latest"), F.col("day").cast("string").alias("day"), "regressing")


@query
def drift_alert(s: SparkSession, d: str) -> DataFrame:
    base, cur = _windows(s, d)
    shifts = monitoring.term_shift(base, cur)
    return monitoring.drift_alert(monitoring.guarded_drift(*_halves(s, d)), shifts, monitoring.regression_alert(monitoring.streaks(bed.daily(s, d))))


# generated answers


@query
def citation_accuracy(s: SparkSession, d: str) -> DataFrame:
    return _rounded(judge.accuracy(bed.judgments(s, d)), "citation_accuracy")


@query
def citation_by_group(s: SparkSession, d: str) -> DataFrame:
    return _rounded(analytics.accuracy_by(bed.judgments(s, d), "query_id"), "accuracy")


@query
def citation_fanout_unretrieved(s: SparkSession, d: str) -> DataFrame:
    """Citations: the documents that hold a query's passage; retrieved: its BM25 list."""
    cited = bed.qrels(s, d).groupBy("query_id").agg(F.collect_set("doc_id").alias("chunk_ids")).withColumn("claim", F.lit("passage"))
    passages = _bm25(s, d, 5).join(bed.docs(s, d), "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), "text")
    verdict = F.when(F.col("supported").isNull(), "to be judged").otherwise("unsupported")
    return judge.fan_out(cited, passages).select("query_id", "chunk_id", verdict.alias("verdict"), F.coalesce("rationale", F.lit("")).alias("rationale"))


@query
def recovered_citations(s: SparkSession, d: str) -> DataFrame:
    """Citations written as JSON, every other one as a JSON string that holds it, and read back; documents without a line break cite nothing."""
    cited = F.array(F.struct(F.col("source").alias("claim"), F.array(F.col("doc_id").cast("string")).alias("chunk_ids")), F.struct(F.lit(None).cast("string").alias("claim"), F.array().cast("array<string>").alias("chunk_ids")))
    plain = F.when(F.contains("text", F.lit("\n")), F.to_json(cited)).otherwise("{}")
    quoted = F.regexp_extract(F.to_json(F.struct(plain.alias("v"))), r'^\{"v":(.*)\}$', 1)
    rows = bed.table(s, d, "documents").select("doc_id", judge.recovered_citations(F.when(F.col("doc_id") % 2 == 0, plain).otherwise(quoted)).alias("c"))
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.get("c", F.lit(0))["claim"].alias("claim"), F.get(F.get("c", F.lit(0))["chunk_ids"], F.lit(0)).alias("chunk_id"))


def _holds(claim: str, passage: str) -> tuple[bool, str]:
    """A stand-in for a judge: whether a passage holds the claim."""
    return claim in passage, "holds it" if claim in passage else "does not"


def _busy(claim: str, passage: str) -> tuple[bool, str]:
    """The same judge, at times out of reach."""
    if len(passage) % 3 == 0:
        raise TimeoutError("no answer")
    return _holds(claim, passage)


def _cited(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Citations: each passage, by the documents that hold it; retrieved: the first five BM25 results."""
    cited = bed.qrels(s, d).join(bed.queries(s, d), "query_id").groupBy("query_id", F.col("query").alias("claim")).agg(F.collect_set(F.col("doc_id").cast("string")).alias("chunk_ids"))
    passages = _bm25(s, d, 5).join(bed.docs(s, d), "doc_id").select("query_id", F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return stored(cited, "cited"), stored(passages, "passages")


def _judged(s: SparkSession, d: str) -> tuple[judge_batches.JudgeRun, list[dict[str, int]]]:
    run = judge_batches.JudgeRun(SnapshotTable(s, f"{shared_dir(s)}/corvane-verdicts-{uuid.uuid4().hex}"))
    cited, passages = _cited(s, d)
    return run, [run.run(cited, passages, judge) for judge in (_busy, _holds, _holds)]


@query
def judged_pairs(s: SparkSession, d: str) -> DataFrame:
    """The verdicts of a run whose judge failed at times, taken up twice."""
    run, _ = _judged(s, d)
    return run.verdicts().select(F.col("query_id").cast("long").alias("query_id"), F.col("chunk_id").cast("long").alias("doc_id"), "supported", "rationale")


@query
def judge_runs(s: SparkSession, d: str) -> DataFrame:
    """What each of three runs found open, judged and failed at: the last finds nothing to do."""
    _, counts = _judged(s, d)
    rows = [(i, *(c[k] for k in ("open", "judged", "unretrieved", "failed"))) for i, c in enumerate(counts, 1)]
    return s.createDataFrame(rows, "run int, open long, judged long, unretrieved long, failed long")


class _Ticking:
    """A clock that stands still but for what is worked and waited."""

    def __init__(self) -> None:
        self.now = 0.0

    def __call__(self) -> float:
        return self.now


def _work(text: str, watch: latency.Stopwatch) -> str:
    """Takes a millisecond for each 100 characters, and 50 milliseconds of waiting."""
    watch.clock.now += len(text) / 100_000
    watch.wait(lambda: setattr(watch.clock, "now", watch.clock.now + 0.05))
    return text[:1]


@query
def step_latency(s: SparkSession, d: str) -> DataFrame:
    """Mean and 95th percentile of the time that a step took for the documents of each language, from two runs' histograms."""
    docs = bed.table(s, d, "documents").select("doc_id", "lang", "text")
    timed = docs.select("doc_id", "lang").join(latency.timed_rows(docs, "doc_id", "text", _work, _Ticking), "doc_id")
    halves = [latency.histogram(timed.where(f"doc_id % 2 = {i}"), ["lang"]) for i in (0, 1)]
    return _rounded(latency.summary(latency.merged(*halves, keys=["lang"]), ["lang"]), "mean_ms", "p95_ms")


@query
def evaluate_node(s: SparkSession, d: str) -> DataFrame:
    """The evaluation step over the documents that hold each passage, as citations, and the first five BM25 results."""
    cited = bed.qrels(s, d).groupBy("query_id").agg(F.collect_set("doc_id").alias("chunk_ids")).withColumn("claim", F.lit("passage"))
    passages = _bm25(s, d, 5).join(bed.docs(s, d), "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), "text")
    return _rounded(flow.evaluate(flow.State(citations=cited), passages, F.col("text").isNotNull()).accuracy, "citation_accuracy")


@query
def labels_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Relevance labels written as JSON lines, twice with different labels, and read back: the last line of a pair counts."""
    path = f"{shared_dir(s)}/corvane-labels-{uuid.uuid4().hex}"
    pairs = bed.qrels(s, d).select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"))
    twice = pairs.select("query_id", "chunk_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"), F.lit("holds it").alias("rationale"))
    readers.write_json_lines(twice, path)
    return readers.relevance_labels(s, path)


@query
def history_append(s: SparkSession, d: str) -> DataFrame:
    """The daily scores, appended in two runs and read back."""
    path, rows = f"{shared_dir(s)}/corvane-history-{uuid.uuid4().hex}", bed.daily(s, d)
    readers.append(rows.where(F.col("day") < SPLIT_DAY), path)
    readers.append(rows.where(F.col("day") >= SPLIT_DAY), path)
    return s.read.parquet(path).select("metric", F.col("day").cast("string").alias("day"), "score")


@query
def snapshot_writes(s: SparkSession, d: str) -> DataFrame:
    """The daily scores in a table of snapshots: two writes, one of them twice, and one that fails; what each said it wrote, and the rows that are there."""
    table, rows = SnapshotTable(s, f"{shared_dir(s)}/corvane-snapshots-{uuid.uuid4().hex}"), bed.daily(s, d)
    early, late = rows.where(F.col("day") < SPLIT_DAY), rows.where(F.col("day") >= SPLIT_DAY)
    broken = late.withColumn("score", F.when(F.col("score") >= 0, F.raise_error(F.lit("no disk")).cast("double")).otherwise(F.col("score")))
    said = [("early", table.try_commit(early, "early")), ("early again", table.try_commit(early, "early")), ("broken", table.try_commit(broken, "late")), ("late", table.try_commit(late, "late"))]
    there = table.read().agg(F.lit("there").alias("write"), F.count(F.lit(1)).alias("written"))
    return s.createDataFrame(said, "write string, written long").unionByName(there)


@query
def snapshot_rows(s: SparkSession, d: str) -> DataFrame:
    """The daily scores, written early days first and then all, replacing them."""
    table, rows = SnapshotTable(s, f"{shared_dir(s)}/corvane-snapshots-{uuid.uuid4().hex}"), bed.daily(s, d)
    table.commit(rows.where(F.col("day") < SPLIT_DAY))
    table.commit(rows, mode="overwrite")
    return table.read().select("metric", F.col("day").cast("string").alias("day"), "score")


@query
def ragas_dataset(s: SparkSession, d: str) -> DataFrame:
    """Contexts of each query in order, as one digest and their number."""
    ranked = _fused(s, d, n=3).join(bed.docs(s, d), "doc_id")
    answers = bed.queries(s, d).select("query_id", F.col("query").alias("question"), F.lit(None).cast("string").alias("answer"))
    got = judge.evaluation_set(answers, ranked)
    return got.select("query_id", F.size("contexts").cast("long").alias("n"), F.sha2(F.array_join("contexts", "\n\n"), 256).alias("contexts_sha256"), "answer", "ground_truth")


@query
def answer_card(s: SparkSession, d: str) -> DataFrame:
    """The card of each query: a citation for each of its first four fused documents."""
    rows = _fused(s, d, n=4).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: F.struct(F.concat(F.lit("claim "), x["rank"].cast("string")).alias("claim"), F.array(x["doc_id"].cast("string")).alias("chunk_ids"))).alias("c")
    )
    return rows.select("query_id", judge.answer_card(F.col("c"), F.col("query_id").cast("string")).alias("card"))


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
