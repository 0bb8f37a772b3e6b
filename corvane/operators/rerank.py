"""Re-ranking with injected scorers and a chain of tiers."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import tokens

Scorer = Callable[[Column, Column], Column]
# Serving modes, best first; each falls to the next ones and at last to the order of the candidates.
SERVING = ["live_frontier", "live_quality", "live_fast", "fallback"]
DEFAULT_MODE = "live_fast"
MODE_VARIABLE = "RERANKER_MODE"


def resolve_mode(mode: str | None = None) -> str:
    """The argument, else the environment's ``RERANKER_MODE``, else the default."""
    return mode or os.environ.get(MODE_VARIABLE, DEFAULT_MODE)


def lexical_overlap(query: Column, text: Column) -> Column:
    """A deterministic scorer: the share of the query's distinct tokens that the text holds."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.size(F.array_intersect(q, tokens(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def by_score(candidates: DataFrame, score: Column, top_k: int, query_id: str = "query_id") -> DataFrame:
    """Sorted by ``score``, ties in the order of the old rank; ranks from 1."""
    order = Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), "prior")
    rows = candidates.withColumn("prior", F.col("rank")).withColumn("score", score)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k).drop("prior")


def fallback(candidates: DataFrame, top_k: int, query_id: str = "query_id") -> DataFrame:
    """The candidates in their order, ranks from 1; scores stay."""
    rows = candidates.withColumn("prior", F.col("rank"))
    order = Window.partitionBy(query_id).orderBy("prior")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k).drop("prior")


def routed(candidates: DataFrame, mode: str, tiers: dict[str, Scorer], top_k: int, query: str = "query", text: str = "text", query_id: str = "query_id") -> DataFrame:
    """Re-ranks with the first tier of ``mode`` that scores all of a query's candidates; else the fallback.

    A tier says that it failed by a null score: a query falls to the next tier as a whole, when the plan runs. A tier that is not set is passed over,
    but ``benchmark`` never falls back. Adds ``tier``.
    """
    if mode not in (*SERVING, "benchmark"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "benchmark" and "benchmark" not in tiers:
        raise NotImplementedError("the benchmark tier is not set")
    chain = ["benchmark"] if mode == "benchmark" else SERVING[SERVING.index(mode) :]
    names = [t for t in chain if t in tiers and t != "fallback"]
    whole = Window.partitionBy(query_id)
    rows = candidates.withColumn("prior", F.col("rank"))
    for n in names:
        rows = rows.withColumn(f"_s_{n}", tiers[n](F.col(query), F.col(text)))
        rows = rows.withColumn(f"_ok_{n}", F.min(F.col(f"_s_{n}").isNotNull()).over(whole))
    tier, score = F.lit("fallback"), F.col("score")
    for n in reversed(names):
        tier, score = F.when(F.col(f"_ok_{n}"), F.lit(n)).otherwise(tier), F.when(F.col(f"_ok_{n}"), F.col(f"_s_{n}")).otherwise(score)
    rows = rows.withColumn("tier", tier).withColumn("score", score)
    key = F.when(F.col("tier") != "fallback", F.round("score", 9))
    order = Window.partitionBy(query_id).orderBy(key.desc_nulls_last(), "prior")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)
    return rows.drop("prior", *[f"_{x}_{n}" for n in names for x in ("s", "ok")])
