"""A corpus pipeline over ``documents``: each stage works on what the one before it kept.

Stages, in order: quality rules (rejected documents and failing lines of the others go), exact dedup (the largest identifier of equal texts stays), n-gram Jaccard join
(five-word shingles, similarity 0.8; one document of each group stays), mixing to target weights (documents are thinned, none repeated) and best-fit
packing. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import shared_dir, table
from corvane.llm.exact_dedup import content_sort
from corvane.llm.mixing import label_domain, mix
from corvane.llm.ngram_jaccard import jaccard_components
from corvane.llm.packing import added_tokens, pack
from corvane.llm.quality_lines import cleaned_text, quality
from corvane.sources.store import remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Target shares of tokens by domain. The total is raised where clean text would want less than there is, so that its target is never below what is present.
MIX_WEIGHTS = {"clean": 0.98, "rough": 0.015, "toxic": 0.005}
CAPACITY = 2048


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep, without the lines that fail; ``n_chars`` is that of the text left.

    Null, empty and short texts fail the base rule and go. Rows are judged one by one, so repeated rows stay repeated; a null identifier, lang or source stays null.
    """
    kept = quality(docs.select(*COLUMNS)).where("kept").withColumn("text", cleaned_text(F.col("text")))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: that with the largest identifier. A null text is an empty one; a null identifier loses against any other."""
    return content_sort(docs.select(*COLUMNS), keep="largest").where("kept").select(*COLUMNS)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least identifier of each group of similar texts.

    Rows that share an identifier are kept if any of them is kept; rows without an identifier stay.
    """
    groups = jaccard_components(docs.select("doc_id", "text"), size=5, num=80, den=100)
    gone = groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where(~F.col("stays")).select("doc_id")
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins the documents to the target weights, each at its rate (0 to 1).

    Null texts count as empty. Repeated rows are documents of their own but share an identifier's fate; a null identifier is one like any other. Labels that are
    null, repeated or of no document: see ``train_classifier``. Without labels all documents are of one domain and stay.
    """
    mixed, _ = mix(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), label_domain(), MIX_WEIGHTS, max_rate=1.0, whole="clean")
    return mixed.where("copies > 0").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of ``CAPACITY`` tokens. A null text is an empty document of one token; every row is packed."""
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, CAPACITY, added=added)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("ngram jaccard join", ngram_jaccard_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the fitted rates nor the tokenizer; ``tests/llm`` holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies ``STAGES`` to ``documents``; each result is written as Parquet in the shared folder and read again, and goes when the next one is there."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corvane-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs
