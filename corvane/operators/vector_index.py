"""Approximate vector search by inverted lists: vectors are filed under the nearest of some centroids, and a query looks into the lists nearest to it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import dense
from corvane.operators.sparse import top_k
from corvane.sources.store import stored

#: Vectors, drawn by identifier, that centroids are fitted on: all that the driver sees of the table.
SAMPLE_ROWS = 32_768
#: Lists at most; about the square root of the number of vectors below that.
MAX_LISTS = 4096
ROUNDS = 12
#: Vectors of one part of a list: a list with more is dealt into parts, so that no task gets a whole frequent list.
PART_ROWS = 20_000
#: Queries whose exact neighbours set how many lists are looked into, and the share of those neighbours that must be in them.
SAMPLE_QUERIES, TARGET = 128, 0.95


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in vectors]).reshape(len(vectors), -1)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids of unit vectors (spherical k-means). A centroid that loses all its vectors moves to the vector that lies farthest from its own."""
    x = _unit(sample)
    x = np.unique(np.round(x, 12), axis=0)
    r = np.random.default_rng(seed)
    centers = x[r.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        near = x @ centers.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        lost = np.flatnonzero(np.bincount(own, minlength=len(centers)) == 0)
        sums[lost] = x[np.argsort(near.max(axis=1), kind="stable")[: len(lost)]]
        centers = _unit(sums)
    return centers


class VectorIndex:
    """Centroids, and every vector filed under its nearest one (list, part, id, v), in range partitions by list."""

    def __init__(self, centers: np.ndarray, filed: DataFrame, probes: int) -> None:
        self.centers, self.filed, self.probes = centers, filed, probes

    @staticmethod
    def build(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", lists: int | None = None, target: float = TARGET) -> VectorIndex:
        """Files all vectors that are not null, of one length each; a zero vector is as near to everything as it is in ``dense.cosine_top_k``.

        Centroids are fitted on at most about ``SAMPLE_ROWS`` vectors, and the number of lists to look into follows from exact neighbours of ``SAMPLE_QUERIES`` of them:
        the least for which those lists hold ``target`` of the neighbours.
        """
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
        n = rows.count()
        lists = min(MAX_LISTS, lists or max(1, math.isqrt(n)))
        drawn = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < math.ceil(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 30))).orderBy("id").toPandas()
        centers = fitted(_matrix(drawn["v"]), lists) if len(drawn) else np.zeros((1, 1))
        sent = rows.sparkSession.sparkContext.broadcast(centers)  # MAX_LISTS rows at most

        def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(list=(_unit(_matrix(b["v"])) @ sent.value.T).argmax(axis=1))

        kinds = dict(rows.dtypes)
        filed = stored(rows.mapInPandas(file, f"id {kinds['id']}, v {kinds['v']}, list int"), "filedvectors")
        parts = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
        filed = filed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64(F.col("id").cast("string")), F.col("parts")).cast("int")).drop("parts")  # MAX_LISTS rows
        filed = stored(filed.repartitionByRange("list", "part").sortWithinPartitions("list", "part"), "vectorlists")
        index = VectorIndex(centers, filed, len(centers))
        if len(drawn):
            index.probes = index._enough(drawn.iloc[np.linspace(0, len(drawn) - 1, min(SAMPLE_QUERIES, len(drawn))).astype(int)], target)
        return index

    def _enough(self, drawn: pd.DataFrame, target: float, k: int = 10) -> int:
        """The least number of lists that hold ``target`` of the true neighbours of the drawn vectors."""
        spark = self.filed.sparkSession
        asked = spark.createDataFrame(pd.DataFrame({"query_id": range(len(drawn)), "v": list(drawn["v"])}), f"query_id long, v {dict(self.filed.dtypes)['v']}")
        true = dense.cosine_top_k(self.filed, asked, k, doc_id="id", vector="v").join(self.filed.select("id", "list"), "id").select("query_id", "list").toPandas()
        order = np.argsort(-(_unit(_matrix(drawn["v"])) @ self.centers.T), axis=1)
        place = np.argsort(order, axis=1)  # of each list in each query's order
        depth = np.sort(place[true["query_id"], true["list"]]) + 1
        return int(depth[math.ceil(target * len(depth)) - 1]) if len(depth) else len(self.centers)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", vector: str = "embedding", doc_id: str = "vec_id") -> DataFrame:
        """query_id, doc_id, score, rank as ``dense.cosine_top_k`` gives them, among the vectors of the ``probes`` lists nearest to each query; all lists make it exact.

        Queries go to the lists that they look into, a row for each; a list's part and its queries meet in one task, and k rows for each query leave it.
        """
        probes = min(probes or self.probes, len(self.centers))
        sent = queries.sparkSession.sparkContext.broadcast(self.centers)

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = np.argsort(-(_unit(_matrix(b["v"])) @ sent.value.T), axis=1, kind="stable")[:, :probes]
                    at = np.repeat(np.arange(len(b)), near.shape[1])
                    yield pd.DataFrame({"q": b["q"].to_numpy()[at], "v": b["v"].to_numpy()[at], "list": near.ravel()})

        kinds, q_kind = dict(self.filed.dtypes), dict(queries.dtypes)[query_id]
        asked = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).where("v is not null").mapInPandas(route, f"q {q_kind}, v {kinds['v']}, list int")
        parts = F.broadcast(self.filed.groupBy(F.col("list").alias("in_list"), F.col("part").alias("in_part")).count().drop("count"))  # MAX_LISTS rows, and one for each PART_ROWS vectors
        # many queries of one list are dealt over copies of it
        asked = stored(asked.join(parts, F.col("list") == F.col("in_list")).select("q", F.col("v").alias("qv"), "in_list", "in_part"), "vectorroutes")
        salts = asked.groupBy(F.col("in_list").alias("l"), F.col("in_part").alias("p")).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("salts"))
        salts = F.broadcast(stored(salts, "vectorsalts"))
        asked = asked.join(salts, (F.col("in_list") == F.col("l")) & (F.col("in_part") == F.col("p"))).withColumn("in_salt", F.pmod(F.xxhash64(F.col("q").cast("string")), F.col("salts")))
        filed = self.filed.join(salts, (F.col("list") == F.col("l")) & (F.col("part") == F.col("p"))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))

        def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or k <= 0:
                return pd.DataFrame(columns=["q", "id", "score"])
            e, names = _unit(_matrix(rows["v"])), rows["id"].to_numpy()
            found = []
            for a in range(0, len(asked), dense.BLOCK):
                part = asked.iloc[a : a + dense.BLOCK]
                for q, s in zip(part["q"], _unit(_matrix(part["qv"])) @ e.T, strict=True):
                    best = np.lexsort((names, -np.round(s, 9)))[:k]
                    found.append(pd.DataFrame({"q": q, "id": names[best], "score": s[best]}))
            return pd.concat(found)

        asked, filed = asked.select("in_list", "in_part", "in_salt", "q", "qv"), filed.select("list", "part", "salt", "id", "v")
        met = filed.groupBy("list", "part", "salt").cogroup(asked.groupBy("in_list", "in_part", "in_salt")).applyInPandas(meet, f"q {q_kind}, id {kinds['id']}, score double")
        return top_k(met.select(F.col("q").alias(query_id), F.col("id").alias(doc_id), "score"), k, query_id, doc_id)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """One row: queries, wanted (rows of ``exact``), met (those that ``found`` has too) and recall."""
    rows = exact.select(query_id, doc_id).join(found.select(query_id, doc_id, F.lit(1).alias("hit")), [query_id, doc_id], "left")
    out = rows.agg(F.countDistinct(query_id).alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("met"))
    return out.withColumn("recall", F.col("met") / F.nullif(F.col("wanted"), F.lit(0)))
