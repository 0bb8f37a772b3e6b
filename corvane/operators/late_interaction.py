"""Late interaction: texts as many token vectors, scored by the sum of each query token's greatest product with a token of the document."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.sparse import top_k
from corvane.operators.vector_index import fitted
from corvane.sources.store import stored

#: An injected model: for each text the vectors of its tokens, all of one length.
TokenEncoder = Callable[[list[str]], list[list[list[float]]]]
BATCH, MAX_TOKENS = 32, 256
#: Token vectors, drawn by a digest, that the lists' centroids are fitted on; lists at most.
SAMPLE_TOKENS, LISTS = 32_768, 1024
#: Bytes of query vectors that one part of a search sends to every task, about.
QUERY_BYTES = 64 << 20
#: Scores of documents and queries that a task holds at a time, and query tokens that are compared with a document at a time.
CELLS, TOKENS = 1_000_000, 1_024


def token_vectors(rows: DataFrame, key: str, encoder: TokenEncoder, text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """key, n and vectors (n unit vectors, one behind the other as doubles) of every text that is not null; tokens from ``max_tokens`` on are cut off. The encoder runs in the tasks, ``BATCH`` texts at a time."""
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in range(0, len(b), BATCH):
                for tokens in encoder(b["t"].iloc[i : i + BATCH].tolist()):
                    x = np.array(tokens[:max_tokens], dtype=float)
                    out.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8) if len(x) else x)
            yield pd.DataFrame({"k": b["k"].array, "n": [len(x) for x in out], "vectors": [x.astype("<f8").tobytes() for x in out]})

    texts = rows.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return texts.mapInPandas(run, "k string, n int, vectors binary").select(F.col("k").cast(kind).alias(key), "n", "vectors")


def _matrix(vectors: bytes, n: int) -> np.ndarray:
    return np.frombuffer(vectors, dtype="<f8").reshape(n, -1)


class TokenIndex:
    """Documents with their token vectors, and for each list of token vectors the documents that have a token in it."""

    def __init__(self, documents: DataFrame, postings: DataFrame, centers: np.ndarray, doc_id: str) -> None:
        self.documents, self.postings, self.centers, self.doc_id = documents, postings, centers, doc_id

    @staticmethod
    def build(vectors: DataFrame, doc_id: str = "doc_id", lists: int | None = None) -> TokenIndex:
        """``vectors`` as ``token_vectors`` gives them. Centroids are fitted on about ``SAMPLE_TOKENS`` token vectors of texts drawn by a digest; every token is filed under the nearest one."""
        documents = stored(vectors.where("n > 0").select(doc_id, "n", "vectors"), "tokenvectors")
        total = documents.agg(F.sum("n")).first()[0] or 0
        share = min(1.0, SAMPLE_TOKENS / max(total, 1))
        drawn = documents.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).orderBy(doc_id).select("n", "vectors").toPandas()
        lists = min(LISTS, lists or max(1, math.isqrt(total) // 2))
        centers = fitted(np.concatenate([_matrix(v, n) for v, n in zip(drawn["vectors"], drawn["n"], strict=True)]), lists) if len(drawn) else np.zeros((1, 1))
        rows = stored(documents.select(F.col(doc_id).cast("string").alias("k"), "n", "vectors").mapInPandas(_listed(centers, 1), "k string, list int"), "listedtokens")
        return TokenIndex(documents, stored(rows.repartitionByRange("list", "k").sortWithinPartitions("list"), "tokenlists"), centers, doc_id)

    def search(self, queries: DataFrame, k: int, probes: int = 4, query_id: str = "query_id") -> DataFrame:
        """query_id, doc_id, score, rank of the first ``k`` documents of each query (query_id, n, vectors).

        Candidates have a token in one of the ``probes`` lists nearest to a query token; each is scored in full, from all its tokens. All lists make the search exact. A
        query or document without tokens finds nothing and is not found. k <= 0 gives no rows. Queries are searched in parts of at most about ``QUERY_BYTES``, which go to every task.
        Where all lists are wanted, every document is a candidate: each is read where it lies, and ``k`` rows for each query and batch are sent on. Else a document meets all queries of a
        part that want it in one row, so its vectors move once a part.
        """
        asked = stored(queries.where("n > 0").select(F.col(query_id).cast("string").alias("q"), "n", "vectors"), "askedtokens")
        size = asked.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0
        parts = max(1, -(-size // QUERY_BYTES))
        found = None
        for i in range(parts):
            part = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == i)
            rows = self._whole(part, k) if probes >= len(self.centers) else self._part(part, k, probes)
            found = rows if found is None else found.unionByName(rows)
        kinds = queries.schema[query_id].dataType, self.documents.schema[self.doc_id].dataType
        return top_k(found.select(F.col("q").cast(kinds[0]).alias(query_id), F.col("k").cast(kinds[1]).alias(self.doc_id), "score"), k, query_id, self.doc_id)

    def _whole(self, asked: DataFrame, k: int) -> DataFrame:
        rows = asked.toPandas()  # QUERY_BYTES, about
        x = np.concatenate([_matrix(v, n) for v, n in zip(rows["vectors"], rows["n"], strict=True)]) if len(rows) else np.zeros((0, 1))
        # a token that several queries hold is compared once
        x, at = np.unique(x, axis=0, return_inverse=True)
        first = np.concatenate([[0], np.cumsum(rows["n"].to_numpy(np.int64))[:-1]]) if len(rows) else np.zeros(0, np.int64)
        names = rows["q"].to_numpy()
        sent = asked.sparkSession.sparkContext.broadcast((x, at.ravel(), first, names))
        step = max(1, CELLS // max(len(names), 1))
        kind = self.documents.schema[self.doc_id].dataType.simpleString()

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, at, first, names = sent.value
            for b in batches:
                for part in (b.iloc[a : a + step] for a in range(0, len(b), step)):
                    if not len(names) or k <= 0:
                        continue
                    sums = np.empty((len(part), len(names)))
                    for i, (n, vectors) in enumerate(zip(part["n"], part["vectors"], strict=True)):
                        y = np.unique(_matrix(vectors, n), axis=0).T
                        best = np.concatenate([(x[a : a + TOKENS] @ y).max(axis=1) for a in range(0, len(x), TOKENS)])
                        sums[i] = np.add.reduceat(best[at], first)
                    ids, found = part["k"].to_numpy(), []
                    for q, s in zip(names, sums.T, strict=True):
                        near = np.round(s, 9)
                        open_ = np.flatnonzero(near >= np.partition(near, -k)[-k]) if len(near) > k else np.arange(len(near))
                        top = open_[np.lexsort((ids[open_], -near[open_]))[:k]]
                        found.append(pd.DataFrame({"q": q, "k": ids[top], "score": s[top]}))
                    yield pd.concat(found)

        documents = self.documents.select(F.col(self.doc_id).alias("k"), "n", "vectors").where("k is not null")
        return documents.mapInPandas(score, f"q string, k {kind}, score double")

    def _part(self, asked: DataFrame, k: int, probes: int) -> DataFrame:
        matrices = {q: _matrix(v, n) for q, n, v in asked.collect()}  # QUERY_BYTES, about
        sent = asked.sparkSession.sparkContext.broadcast(matrices)
        wanted = asked.select(F.col("q").alias("k"), "n", "vectors").mapInPandas(_listed(self.centers, probes), "k string, list int").select(F.col("k").alias("q"), "list")
        pairs = wanted.join(self.postings, "list").select("q", "k").distinct()
        pairs = pairs.groupBy("k").agg(F.collect_list("q").alias("qs"))  # at most the queries of a part
        documents = self.documents.select(F.col(self.doc_id).cast("string").alias("k"), "n", "vectors")

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for name, n, vectors, qs in zip(b["k"], b["n"], b["vectors"], b["qs"], strict=True):
                    y = _matrix(vectors, n).T
                    out += [(q, name, float((sent.value[q] @ y).max(axis=1).sum())) for q in qs]
                yield pd.DataFrame(out, columns=["q", "k", "score"])

        return pairs.join(documents, "k").select("k", "n", "vectors", "qs").mapInPandas(score, "q string, k string, score double")


def _listed(centers: np.ndarray, probes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """k and the lists nearest to its tokens, each list once a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, n, vectors in zip(b["k"], b["n"], b["vectors"], strict=True):
                near = _matrix(vectors, n) @ centers.T
                near = near.argmax(axis=1) if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
                out += [(k, int(x)) for x in np.unique(near)]
            yield pd.DataFrame(out, columns=["k", "list"])

    return run
