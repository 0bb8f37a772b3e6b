"""Reciprocal rank fusion and operations on ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: list[DataFrame], top_k: int = 10, k: int = RRF_K, query_id: str = "query_id", doc_id: str = "doc_id", weights: list[float] | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: score is the sum of 1 / (k + rank) over the lists, with each row's own rank.

    Ties keep the order in which documents are first seen: all of the first list in order, then new ones of the second. A ``text`` column, if
    the lists have one, comes from the first list that holds the document. top_k <= 0 gives no rows.
    """
    has_text = all("text" in x.columns for x in lists)
    rows = None
    for n, x in enumerate(lists):
        part = x.select(query_id, doc_id, F.lit(n).alias("list_no"), F.col("rank").cast("long").alias("rank"), F.lit(float((weights or [1.0] * len(lists))[n])).alias("w"), *(["text"] if has_text else []))
        rows = part if rows is None else rows.unionByName(part)
    seen = F.struct("list_no", "rank")
    agg = [F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.min(seen).alias("seen")]
    if has_text:
        agg.append(F.min_by("text", seen).alias("text"))
    fused = rows.groupBy(query_id, doc_id).agg(*agg)
    order = Window.partitionBy(query_id).orderBy(F.round("score", 12).desc(), "seen", doc_id)
    out = fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)
    return out.select(query_id, doc_id, "score", "rank", *(["text"] if has_text else []))


def overlap(a: DataFrame, b: DataFrame, n: int = 5, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """query_id, overlap: how many of the first n both lists hold; 0 where they share none."""
    left = a.where(F.col("rank") <= n).select(query_id, doc_id)
    right = b.where(F.col("rank") <= n).select(query_id, doc_id, F.lit(1).alias("hit"))
    return left.join(right, [query_id, doc_id], "left").groupBy(query_id).agg(F.count("hit").alias("overlap"))


def results(fused: DataFrame, reranked: DataFrame, top_k: int, query_id: str = "query_id") -> DataFrame:
    """The re-ranked rows of queries that have any, else the first top_k fused rows."""
    rest = fused.where(F.col("rank") <= top_k).join(reranked.select(query_id).distinct(), query_id, "left_anti")
    return reranked.select(rest.columns).unionByName(rest)
