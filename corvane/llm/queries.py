"""One registered query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from corvane.llm import brown_lm, oracles, toxicity
from corvane.llm.collocations import collocations
from corvane.llm.common import shared_dir, table
from corvane.llm.exact_dedup import content_sort
from corvane.llm.hash_forest import nearest
from corvane.llm.html_text import extract
from corvane.llm.mixing import label_domain, mix
from corvane.llm.ngram_jaccard import jaccard_components
from corvane.llm.packing import added_tokens, pack
from corvane.llm.periodic_runs import periodic_runs
from corvane.llm.quality_lines import quality
from corvane.llm.url_filter import Rule, judge_urls, spam_listing
from corvane.llm.warc import capture_digests, read_archive, transactions, write_archive

# The rules of the URL query.
RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]
# Host labels that put a crawled page on the block list.
SPAM_LABELS = ["cheap-pills", "casino-win", "free-bets", "spam-farm", "ads-track"]
# The target shares of tokens by domain.
MIX_WEIGHTS = {"clean": 0.90, "rough": 0.07, "toxic": 0.03}


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, num=90, den=100)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = toxicity.severity(F.col("toxic"), F.col("quality"))
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), grade))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, the posterior of each domain, rate and copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed, domains = mix(docs, table(spark, sf_dir, "labels"), label_domain(), MIX_WEIGHTS, columns=["doc_id"])
    return mixed.select("doc_id", "tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)], "rate", "copies")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    got = judge_urls(pages, spam_listing(pages, SPAM_LABELS), RULES)
    return got.select("page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, capacity=2048, added=added)


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return brown_lm.score(docs, held_out)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/corvane-warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path, min_bytes=0)
    return capture_digests(transactions(read_archive(spark, path, bodies=False)))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"), least=10, top=2000)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True).drop("runs", "text_out")


def op13_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_ngram_jaccard, op2_quality_rules, op3_toxicity, op4_mixing, op5_exact_dedup, op6_url_filter, op7_packing, op8_brown_lm, op9_warc, op10_html_text,
        op11_collocations, op12_periodic_runs, op13_hash_forest,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": oracles.JACCARD, "op2_quality_rules": oracles.QUALITY, "op5_exact_dedup": oracles.EXACT_DEDUP,
        "op6_url_filter": oracles.url_filter(RULES, SPAM_LABELS), "op9_warc": oracles.WARC,
        "op11_collocations": oracles.COLLOCATIONS,
    }
