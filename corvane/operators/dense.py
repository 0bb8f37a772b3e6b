"""Dense retrieval: exact cosine top-k of a query set against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.sparse import top_k
from corvane.sources.store import stored

#: Query vectors that one block scores; more are dealt to several passes of a batch.
BLOCK = 1024
#: Query vectors, in bytes (8 a number), that one part of a search sends to every executor, about.
QUERY_BYTES = 128 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(size == 0, 1e-8).otherwise(size)


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """query_id, doc_id, score, rank: exact cosine top-k, ties by identifier.

    Queries are dealt by their identifiers to parts of at most about ``QUERY_BYTES``; each part is read from its own rows when it is sent, and passes over the corpus once. A task
    scores its batches against the part with one matrix product and sends on k rows for each query and batch, so what shuffles does not
    grow with the number of pairs. Null vectors are left out; k <= 0 gives no rows.
    """
    asked = queries.select(query_id, vector).where(F.col(vector).isNotNull())
    size = 8 * (asked.agg(F.sum(F.size(vector))).first()[0] or 0)
    parts = max(1, -(-size // QUERY_BYTES))
    if parts > 1:
        asked = stored(asked, "askedvectors")
    kinds = dict(corpus.dtypes)[doc_id], dict(queries.dtypes)[query_id]
    rows = corpus.select(F.col(doc_id).alias("id"), F.col(vector).alias("v")).where("v is not null")
    found = None
    for i in range(parts):
        part = asked if parts == 1 else asked.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == i)
        scored = rows.mapInPandas(_scored(part, k, vector, query_id), f"query {kinds[1]}, id {kinds[0]}, score double")
        found = scored if found is None else found.unionByName(scored)
    return top_k(found.select(F.col("query").alias(query_id), F.col("id").alias(doc_id), "score"), k, query_id, doc_id)


def _scored(asked: DataFrame, k: int, vector: str, query_id: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sends one part of the queries to the executors: query, id and score of the first ``k`` rows of each batch for each of its queries."""
    rows = asked.toPandas()  # QUERY_BYTES, about
    ids = rows[query_id].to_numpy()
    q = np.array([np.asarray(v, dtype=float) for v in rows[vector]])
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-8) if len(ids) else q
    sent = asked.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        for batch in batches:
            if not len(ids) or not len(batch) or k <= 0:
                continue
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            e = np.stack([np.asarray(v, dtype=float) for v in batch["v"]])
            e = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-8)
            names = batch["id"].to_numpy()
            for a in range(0, len(ids), BLOCK):
                score = q[a : a + BLOCK] @ e.T
                for i, s in enumerate(score):
                    best = np.lexsort((names, -np.round(s, 9)))[:k]
                    found.append((np.repeat(ids[a + i : a + i + 1], len(best)), names[best], s[best]))
            yield pd.DataFrame(dict(zip(("query", "id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def centroid(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row, one column ``centroid``: the mean vector (sums by position; as many groups as dimensions)."""
    means = vectors.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def project(vectors: DataFrame, center: DataFrame, vector: str = "embedding", name: str = "x") -> DataFrame:
    """Adds ``name``: the cosine of every vector to the one row of ``center``."""
    return vectors.crossJoin(F.broadcast(center)).withColumn(name, cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def collection_stats(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("points"), F.max(F.size(vector)).cast("long").alias("dimension"))
