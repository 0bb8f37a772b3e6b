"""Readers and writers of the engine's files, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the engine's tables and files.
SCHEMAS = {
    "doc_metadata": "doc_id string, title string, source_url string, gpu_family string, doc_type string, page_count int, last_ingested timestamp, ingestion_run string, created_at timestamp, content_sha256 string",
    "chunks": "chunk_id string, doc_id string, chunk_text string, chunk_index int, token_count int, section_heading string, created_at timestamp",
    "chunk_quality": "chunk_id string, quality_score double, mean_sent_len double, nonascii_ratio double, stopword_ratio double, flagged boolean, scored_at timestamp",
    "coverage_log": "run_id string, total_manifest int, total_indexed int, coverage_pct double, missing_docs array<string>, checked_at timestamp",
    "duplicate_flags": "chunk_id_a string, chunk_id_b string, similarity double, flagged_at timestamp",
    "query_log": "query_id string, session_id string, query_text string, reranker_config string, num_candidates int, source string, created_at timestamp",
    "eval_results": "eval_id string, query_id string, faithfulness double, answer_relevancy double, context_precision double, citation_accuracy double, hallucination_rate double, ndcg_at_10 double, mrr double, evaluated_at timestamp",
    "request_log": "request_id string, query_id string, endpoint string, reranker_config string, stage string, duration_ms double, status_code int, created_at timestamp",
    "error_log": "error_id string, endpoint string, error_type string, message string, stack_trace string, created_at timestamp",
    "feedback_log": "feedback_id string, query_id string, user_id string, reaction string, source string, created_at timestamp",
    "benchmark_results": "result_id string, run_id string, config string, query_id string, ndcg_at_10 double, mrr double, prec_at_3 double, prec_at_5 double, prec_at_10 double, faithfulness double, citation_accuracy double, latency_ms double, cost_usd double, created_at timestamp",
    "manifest": "url string, title string, gpu_family string, doc_type string, filename string",
    "benchmark_queries": "query_id string, query string",
    "relevance_labels": "query_id string, chunk_id string, label int, rationale string",
    "candidates": "query_id string, chunk_id string, text string, score double, rank int",
}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def json_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A JSON-lines file with a declared schema; a malformed line fails the read."""
    return spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST").json(path)


def relevance_labels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, chunk_id, label; of repeated pairs the last line of the last file (by path) counts."""
    rows = json_lines(spark, path, "relevance_labels")
    # within a split, rows are numbered as they are read
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n"))
    return rows.withColumn("_at", at).groupBy("query_id", "chunk_id").agg(F.max_by("label", "_at").alias("label"))


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """config, run_id, mean_ndcg_at_10, mean_mrr, num_queries of a committed benchmark snapshot."""
    rows = spark.read.option("multiLine", "true").schema("results array<struct<config:string,run_id:string,mean_ndcg_at_10:double,mean_mrr:double,num_queries:int>>").json(path)
    return rows.select(F.inline("results"))


def cached_pools(spark: SparkSession, path: str, method: str = "method_c_rrf") -> DataFrame:
    """query_id, chunk_id, text, score, rank of saved candidate pools: a JSON array of cases, each with its candidates under ``method``."""
    candidate = "array<struct<chunk_id:string,text:string,score:double,rank:int>>"
    rows = spark.read.option("multiLine", "true").schema(f"query_id string, {method} {candidate}").json(path)
    return rows.select("query_id", F.inline(method))


def write_contexts(ranked: DataFrame, path: str) -> None:
    """Saves re-ranked contexts for a later run, one JSON line for each query: query_id, query and reranked (chunk_id, text, score, rank, in order of rank).

    ``ranked`` has a row for each result (query_id, query, chunk_id, text, score, rank).
    """
    each = F.struct(F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), "text", F.col("score").cast("double").alias("score"))
    lists = ranked.groupBy(F.col("query_id").cast("string").alias("query_id"), "query").agg(F.array_sort(F.collect_list(each)).alias("r"))
    lists.select("query_id", "query", F.transform("r", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"), x["score"].alias("score"), x["rank"].alias("rank"))).alias("reranked")).write.json(path)


def contexts(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, chunk_id, text, score, rank of saved contexts."""
    candidate = "array<struct<chunk_id:string,text:string,score:double,rank:int>>"
    rows = spark.read.schema(f"query_id string, query string, reranked {candidate}").option("mode", "FAILFAST").json(path)
    return rows.select("query_id", "query", F.inline("reranked"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Appends to a Parquet table: Spark's commit makes all rows of the job visible, or none."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def save_index(parts: dict[str, DataFrame], path: str) -> None:
    """Writes the parts of a retrieval index (postings, lengths, term statistics, vectors), one Parquet folder each."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
