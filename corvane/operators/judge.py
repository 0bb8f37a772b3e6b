"""Post-processing of generated answers: citations, judgments and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITATIONS = "array<struct<claim:string,chunk_ids:array<string>>>"
NOT_FOUND = "cited chunk_id not found in retrieved passages"


def recovered_citations(raw: Column) -> Column:
    """Citations from a JSON array, or from a JSON string that holds one; entries without a claim go, missing ids are []."""
    inner = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]
    parsed = F.coalesce(F.from_json(raw, CITATIONS), F.from_json(inner, CITATIONS), F.array().cast(CITATIONS))
    whole = F.filter(parsed, lambda c: c["claim"].isNotNull())
    none = F.array().cast("array<string>")
    return F.transform(whole, lambda c: F.struct(c["claim"].alias("claim"), F.coalesce(c["chunk_ids"], none).alias("chunk_ids")))


def fan_out(citations: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, claim, chunk_id, text, supported, rationale: one row for each cited identifier.

    An identifier that was not retrieved is unsupported without being judged; the others wait for a judge (supported is null).
    """
    rows = citations.select("query_id", "claim", F.explode("chunk_ids").alias("chunk_id"))
    found = rows.join(passages.select("query_id", "chunk_id", "text", F.lit(True).alias("hit")), ["query_id", "chunk_id"], "left")
    lost = F.col("hit").isNull()
    return found.select(
        "query_id", "claim", "chunk_id", "text", F.when(lost, F.lit(False)).alias("supported"), F.when(lost, F.lit(NOT_FOUND)).alias("rationale")
    )


def judged(pairs: DataFrame, judge: Column) -> DataFrame:
    """Fills in ``supported`` with an injected judge's verdict; pairs for which it has none (null) are dropped."""
    return pairs.withColumn("supported", F.coalesce("supported", judge)).where("supported is not null")


def label_pool(pairs: DataFrame, judge: Column) -> DataFrame:
    """``pairs`` (each query with each document of its pool) with label, an injected judge's 0 or 1; pairs for which it has none are dropped."""
    return pairs.withColumn("label", judge).where("label is not null")


def accuracy(judgments: DataFrame) -> DataFrame:
    """One row: the share of supported judgments, 0 if there are none."""
    return judgments.agg(F.coalesce(F.avg(F.col("supported").cast("int")), F.lit(0.0)).alias("citation_accuracy"))


def evaluation_set(answers: DataFrame, ranked: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """query_id, question, answer, contexts (texts in order of rank), ground_truth."""
    lists = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("contexts"))
    rows = answers.join(lists, "query_id", "left")
    rows = rows.join(truth.select("query_id", "ground_truth"), "query_id", "left") if truth is not None else rows.withColumn("ground_truth", F.lit(""))
    empty = F.array().cast("array<string>")
    return rows.select("query_id", "question", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("contexts", empty).alias("contexts"), F.coalesce("ground_truth", F.lit("")).alias("ground_truth"))


def metrics_for(truth: list[str | None]) -> list[str]:
    """The metrics to ask for: context_precision only with a ground truth."""
    base = ["faithfulness", "answer_relevancy"]
    return [*base, "context_precision"] if any(truth) else base


def average_scores(scores: DataFrame) -> DataFrame:
    """Means of all numeric columns."""
    return scores.agg(*[F.avg(c).alias(c) for c, t in scores.dtypes if t in ("double", "float", "int", "bigint")])


def answer_card(citations: Column, query_id: Column, n: int = 3) -> Column:
    """The text of an answer card: up to n numbered citations and the footer that names the query."""
    lines = F.transform(
        F.slice(citations, F.lit(1), F.lit(n)),
        lambda c, i: F.concat(F.lit("*"), (i + 1).cast("string"), F.lit(".* "), c["claim"], F.lit("\n   `"), F.coalesce(F.nullif(F.array_join(c["chunk_ids"], ", "), F.lit("")), F.lit("no chunk_id")), F.lit("`")),
    )
    top = F.when(F.size(lines) > 0, F.concat(F.lit("*Top citations:*\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return F.concat(top, F.lit("query_id: `"), query_id, F.lit("`"))
