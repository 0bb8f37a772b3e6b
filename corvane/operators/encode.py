"""Encoder seams: injected models over Arrow batches, and what needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators.sparse import sparse_dot, top_k

SparseEncoder = Callable[[list[str]], list[dict[str, float]]]
DenseEncoder = Callable[[list[str]], list[list[float]]]
# What models want before a query and before a passage; models that are not named want nothing.
PREFIXES = {"e5-base-v2": {"query": "query: ", "passage": "passage: "}}
DEFAULT_MODEL = "e5-base-v2"
#: Texts that an encoder gets at a time.
BATCH = 32
#: Positions of a text that a sparse model reads.
MAX_LENGTH = 256


def prefixed(text: Column, side: str, model: str | None = None) -> Column:
    """``text`` as ``model`` (the winner of an evaluation, else the default) wants a query or a passage; null stays null."""
    if side not in ("query", "passage"):
        raise ValueError(f"side must be 'query' or 'passage', not {side!r}")
    return F.concat(F.lit(PREFIXES.get(model or DEFAULT_MODEL, {}).get(side, "")), text)


def sparse_vectors(rows: DataFrame, key: str, text: str = "text", encoder: SparseEncoder | None = None, batch: int = BATCH) -> DataFrame:
    """key, term, weight: the non-zero weights of every text. Without an encoder they are log(1 + count) of its tokens.

    Null and blank texts have none. An encoder runs in the tasks, ``batch`` texts at a time.
    """
    if encoder is None:
        toks = rows.select(key, F.explode(tokens(F.col(text))).alias("term"))
        return toks.groupBy(key, "term").agg(F.log1p(F.count(F.lit(1))).alias("weight"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                for k, vector in zip(part["k"], encoder(part["t"].tolist()), strict=True):
                    out += [(k, term, float(w)) for term, w in vector.items() if w]
            yield pd.DataFrame(out, columns=["k", "term", "weight"])

    texts = rows.where(F.col(text).rlike(r"\S")).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return texts.mapInPandas(run, "k string, term string, weight double").select(F.col("k").cast(rows.schema[key].dataType).alias(key), "term", "weight")


def pooled(logits: DataFrame, key: str, max_length: int = MAX_LENGTH, position: str = "position", mask: str | None = "mask") -> DataFrame:
    """key, term, weight from a model's logits in long form (key, position, term, logit): the greatest log(1 + relu(logit)) of a vocabulary entry over the text's positions.

    Positions from ``max_length`` on are cut off; masked ones (``mask`` 0: padding) count 0; entries that nothing raises above 0 have no row. Null logits are left out. The
    greatest of each task's part goes over the shuffle, so a text's rows need not be together.
    """
    used = logits.where((F.col(position) < max_length) & (F.col("logit") > 0))
    used = used.where(F.coalesce(F.col(mask), F.lit(0)) > 0) if mask else used
    return used.groupBy(key, "term").agg(F.log1p(F.max("logit")).alias("weight"))


def dense_vectors(rows: DataFrame, key: str, encoder: DenseEncoder, text: str = "text", batch: int = BATCH) -> DataFrame:
    """key, embedding of every text that is not null; an encoder runs in the tasks, ``batch`` texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [v for i in range(0, len(b), batch) for v in encoder(b["t"].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({"k": b["k"].array, "embedding": [list(map(float, v)) for v in found]})

    texts = rows.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return texts.mapInPandas(run, "k string, embedding array<double>").select(F.col("k").cast(rows.schema[key].dataType).alias(key), "embedding")


def sparse_top_k(docs: DataFrame | None, queries: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """query_id, doc_id, score, rank by the dot product of sparse vectors (key, term, weight). A query without weights finds nothing; no index is an error."""
    if docs is None:
        raise RuntimeError("the sparse index has not been built")
    return top_k(sparse_dot(queries, docs, query_id, doc_id), k, query_id, doc_id)
