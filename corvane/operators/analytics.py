"""Catalogue analytics over documents, chunks and quality, and dashboard aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.quantiles import quantiles


def count_by_family(docs: DataFrame, family: str = "gpu_family") -> DataFrame:
    """Documents of each family. The label Unknown stands for null and for empty, after grouping: there may be two such rows."""
    label = F.when(F.col(family).isNull() | (F.col(family) == ""), "Unknown").otherwise(F.col(family))
    return docs.groupBy(family).agg(F.count(F.lit(1)).alias("n")).select(label.alias("family"), "n").orderBy(F.desc("n"), "family")


def below_threshold(quality: DataFrame, threshold: float) -> DataFrame:
    return quality.where(F.col("quality_score") < threshold).select("chunk_id", "quality_score").orderBy("quality_score", "chunk_id")


def exact_mean(value: str, places: int) -> Column:
    """The mean of numbers of ``places`` decimal places, rounded half-up (they are not negative): from whole numbers, so that it is the same in whatever order they are summed."""
    units = f"sum(cast(round({value} * {10**places}) as long))"
    return F.expr(f"((2 * {units} + count({value})) div (2 * count({value}))) / {10**places}.0D")


def avg_quality_per_title(docs: DataFrame, chunks: DataFrame, quality: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "title").join(chunks.select("doc_id", "chunk_id"), "doc_id").join(quality.select("chunk_id", "quality_score"), "chunk_id")
    return rows.groupBy("title").agg(exact_mean("quality_score", 4).alias("avg_quality"), F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("avg_quality"), "title")


def chunk_count_like(docs: DataFrame, chunks: DataFrame, fragment: str) -> DataFrame:
    """Chunks of each title that holds ``fragment``, whatever the case; % and _ in it are wildcards."""
    rows = docs.where(F.col("title").ilike(f"%{fragment}%")).select("doc_id", "title").join(chunks.select("doc_id"), "doc_id")
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("chunks"))


def list_docs(docs: DataFrame) -> DataFrame:
    return docs.orderBy("title", "doc_id")


def latest_by(rows: DataFrame, key: str, started: str, value: str, tie: str) -> DataFrame:
    """The row of each key that started last."""
    return rows.groupBy(key).agg(F.max_by(F.struct(started, value), F.struct(started, tie)).alias("r")).select(key, f"r.{started}", f"r.{value}")


def newest(rows: DataFrame, started: str, value: str, tie: str) -> DataFrame:
    """One row: the value of the run that started last, even if it is null. No rows give null."""
    return rows.agg(F.max_by(F.struct(value), F.struct(started, tie)).alias("r")).select(F.col(f"r.{value}").alias(value))


def latest_complete(rows: DataFrame, started: str, values: list[str], tie: str) -> DataFrame:
    """The last row in which none of ``values`` is null."""
    full = rows.where(" and ".join(f"{v} is not null" for v in values))
    return full.agg(F.max_by(F.struct(started, *values), F.struct(started, tie)).alias("r")).select("r.*")


def stage_latency(log: DataFrame, stage: str = "stage", ms: str = "duration_ms") -> DataFrame:
    return quantiles(log, ms, [0.5, 0.95], (stage,)).select(stage, F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p95"))


def daily_error_rate(log: DataFrame, day: str, is_error: str) -> DataFrame:
    out = log.groupBy(day).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col(is_error)).alias("errors"))
    return out.withColumn("error_rate", F.round(F.col("errors") / F.col("requests"), 4))


def accuracy_by(judgments: DataFrame, key: str) -> DataFrame:
    out = judgments.groupBy(key).agg(F.count_if("supported").alias("supported"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("accuracy", F.col("supported") / F.col("total"))


def relevance_percent(ranked: DataFrame, query_id: str = "query_id") -> DataFrame:
    """20 to 100 between a result list's least and greatest score; 100 where they are equal."""
    whole = Window.partitionBy(query_id)
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    part = F.floor(20 + (F.col("score") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * 80 + 0.5)
    return ranked.withColumn("low", low).withColumn("high", high).withColumn("percent", F.coalesce(part, F.lit(100)).cast("long")).drop("low", "high")


Tool = Callable[..., DataFrame]
#: Named catalogue queries with the parameters that each takes and their types.
TOOLS: dict[str, tuple[Tool, dict[str, type]]] = {
    "count_docs_by_gpu_family": (lambda t: count_by_family(t["docs"]), {}),
    "chunks_below_quality_threshold": (lambda t, threshold: below_threshold(t["quality"], threshold), {"threshold": float}),
    "avg_quality_per_doc": (lambda t: avg_quality_per_title(t["docs"], t["chunks"], t["quality"]), {}),
    "chunk_count_for_doc": (lambda t, title_fragment: chunk_count_like(t["docs"], t["chunks"], title_fragment), {"title_fragment": str}),
    "list_indexed_documents": (lambda t: list_docs(t["docs"]), {}),
}


def dispatch(tables: dict[str, DataFrame], tool: str, params: dict[str, object]) -> DataFrame:
    """Runs a catalogue query by name; parameters are coerced to their types."""
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool!r}")
    run, kinds = TOOLS[tool]
    return run(tables, **{k: kind(params[k]) for k, kind in kinds.items()})
