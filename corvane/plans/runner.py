"""The ingestion run without a scheduler: the same stages in order, and an exit code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import quality
from corvane.operators import ingest
from corvane.sources.store import stored


def run_ingest(manifest: DataFrame, files: DataFrame, pages: DataFrame, out: str) -> int:
    """Writes docs, chunks, chunk_quality and coverage below ``out``; 1 if any document of the manifest failed, else 0.

    ``manifest`` has doc_id and title, ``files`` doc_id and is_pdf, ``pages`` (doc_id, page, text, heading) what an extractor found in them. Documents that
    failed are reported, and the others go on.
    """
    spark = manifest.sparkSession
    report = stored(ingest.download_report(manifest, files, "doc_id"), "downloads")
    good = report.where("status = 'ok'").select("doc_id")
    parts = stored(ingest.page_offsets(pages.join(good, "doc_id")), "parts")
    texts = ingest.assembled(parts)
    texts.join(manifest, "doc_id").select("doc_id", "title", F.sha2("full_text", 256).alias("content_sha256")).write.mode("overwrite").parquet(f"{out}/docs")
    heads = parts.select("doc_id", F.col("char_offset").alias("offset"), "heading")
    ingest.emitted_chunks(texts, heads).write.mode("overwrite").parquet(f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    chunks.select("chunk_id", quality(F.col("chunk_text")).alias("q")).select("chunk_id", "q.*").write.mode("overwrite").parquet(f"{out}/chunk_quality")
    ingest.coverage(manifest, chunks, "doc_id").write.mode("overwrite").parquet(f"{out}/coverage")
    return int(not report.where("status <> 'ok'").isEmpty())
