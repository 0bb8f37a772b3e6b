"""Sparse retrieval: postings, BM25 and sparse dot products, for all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators.ingest import numbered
from corvane.sources.store import stored

K1, B, EPSILON = 1.5, 0.75, 0.25


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """query_id, term, qtf: the tokens of every query with their multiplicity."""
    return queries.select(query_id, F.explode(tokens(F.col(text))).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, tf, dl: one row for each document and term."""
    toks = docs.select(doc_id, tokens(F.col(text)).alias("toks"))
    rows = toks.select(doc_id, F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("term"))
    return rows.groupBy(doc_id, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df, idf of the whole vocabulary, and avgdl, in one pass over the texts.

    idf = ln(N - df + .5) - ln(df + .5); a negative one becomes EPSILON times the mean over all terms (negatives included). An empty term in every document stands for the
    documents and carries their length; terms are counted in each task before they shuffle, a row for each task that holds the term.
    """
    toks = docs.where(F.col(text).isNotNull()).select(tokens(F.col(text)).alias("toks"))  # a condition on the tokens would find them twice
    held = toks.select(F.size("toks").cast("long").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("toks"))).alias("term"))
    counts = stored(held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total")), "frequencies")
    whole = counts.where("term = ''").agg(F.max("df").alias("n"), F.max("total").alias("all"))
    return weighted(counts.where("term <> ''").drop("total"), whole)


def weighted(frequencies: DataFrame, whole: DataFrame) -> DataFrame:
    """``statistics`` from document frequencies (term, df) and one row with the number of documents and of their tokens (n, all)."""
    raw = frequencies.crossJoin(F.broadcast(whole)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # whole is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    out = raw.crossJoin(F.broadcast(mean))
    return out.select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), (F.col("all") / F.col("n")).alias("avgdl"))


def term_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df, idf of the whole vocabulary."""
    return statistics(docs, text).drop("avgdl")


def hits(docs: DataFrame, terms: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, doc_id, term, qtf, tf, dl for the documents that hold a query term.

    The join with the queries' terms comes before the count of term frequencies, so tokens that no query asks for never shuffle.
    """
    toks = docs.select(doc_id, tokens(F.col(text)).alias("toks")).select(doc_id, F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("term"))
    wanted = terms.select("term").distinct()
    tf = toks.join(wanted, "term").groupBy(doc_id, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(terms, "term").select(query_id, doc_id, "term", "qtf", "tf", "dl")


def bm25_scores(docs: DataFrame, terms: DataFrame, stats: DataFrame | None = None, query_id: str = "query_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, doc_id, score of every document that holds a query term (the Okapi formula, query terms with multiplicity). ``stats`` are those of ``statistics``."""
    stats = statistics(docs, text) if stats is None else stats
    idf = stats.join(terms.select("term").distinct(), "term")
    return bm25_from_hits(hits(docs, terms, query_id, doc_id, text), idf, query_id, doc_id)


def bm25_from_hits(found: DataFrame, idf: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """``bm25_scores`` from rows of ``hits`` and the statistics of the queries' terms."""
    rows = found.join(idf, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy(query_id, doc_id).agg(F.sum(part).alias("score"))


def dot_scores(docs: DataFrame, terms: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, doc_id, score: the dot product of term counts (a stand-in for a learned sparse encoder)."""
    return dot_from_hits(hits(docs, terms, query_id, doc_id, text), query_id, doc_id)


def dot_from_hits(found: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """``dot_scores`` from rows of ``hits``."""
    return found.groupBy(query_id, doc_id).agg(F.sum(F.col("qtf") * F.col("tf")).cast("double").alias("score"))


def overlap_from_hits(found: DataFrame, terms: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """query_id, doc_id, overlap: the share of a query's distinct tokens that a document holds, for documents that hold any. No text is read."""
    sizes = terms.groupBy(query_id).agg(F.count(F.lit(1)).alias("_terms"))
    held = found.groupBy(query_id, doc_id).agg(F.count(F.lit(1)).alias("_held"))
    return held.join(sizes, query_id).select(query_id, doc_id, (F.col("_held") / F.col("_terms")).alias("overlap"))


def sparse_dot(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Dot products of sparse vectors in long form (id, term, weight), for pairs that share a term."""
    pairs = a.select(F.col(left), "term", F.col("weight").alias("wa")).join(b.select(F.col(right), "term", F.col("weight").alias("wb")), "term")
    return pairs.groupBy(left, right).agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def top_k(scores: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Adds rank (long, from 1) and keeps the first k of each query: by score to nine places, then by identifier."""
    order = Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), F.col(doc_id))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def search(scores: DataFrame, docs: DataFrame, terms: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """The first k documents of every query that has a token; documents without a hit score 0 and may fill the list.

    Scores are computed once: the first k of each query are stored, with how many hits it has. Fill-ups are needed only by queries with fewer
    than k positive hits, and come from the lowest identifiers: as many as such a query has hits, and k more. k <= 0 gives no rows.
    """
    if k <= 0:
        return top_k(scores, 0, query_id, doc_id)
    held = scores.groupBy(query_id).agg(F.count_if(F.col("score") > 0).alias("positive"), F.count(F.lit(1)).alias("all"))
    first = stored(top_k(scores, k, query_id, doc_id).join(held, query_id), "topk")
    lists = first.drop("positive", "all")
    known = first.groupBy(query_id).agg(F.max("positive").alias("positive"), F.max("all").alias("all"))
    short = terms.select(query_id).distinct().join(known, query_id, "left").where(F.coalesce("positive", F.lit(0)) < k)
    short = stored(short.select(query_id, F.coalesce("all", F.lit(0)).alias("all")), "shortqueries")
    if short.isEmpty():
        return lists
    hit = scores.join(short.select(query_id), query_id, "left_semi")
    # a query needs no more than the lowest k + (its hits) identifiers, whose places it is joined with: as many rows as it has hits, and k
    places = numbered(docs.select(doc_id).distinct(), doc_id, "_place")
    wanted = short.select(query_id, F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") + (k - 1))).alias("_place"))
    zeros = wanted.join(places, "_place").select(query_id, doc_id).join(hit.select(query_id, doc_id), [query_id, doc_id], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(lists.drop("rank").unionByName(zeros), k, query_id, doc_id)
