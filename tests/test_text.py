"""Text measures on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T


def value(spark: SparkSession, text: str | None, f) -> object:
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


def test_tokens(spark: SparkSession) -> None:
    assert value(spark, "CUDA 3.0 api", T.tokens) == ["cuda", "3", "0", "api"]
    assert value(spark, "naïve café ok_1 Ünder", T.tokens) == ["ok_1"]  # a run that touches another letter is none


def test_ratios(spark: SparkSession) -> None:
    assert value(spark, "ab的的", T.nonascii_ratio) == 0.5
    assert value(spark, "", T.nonascii_ratio) == 0.0
    assert value(spark, "GPU memory is fast. CPU memory is slow.", T.mean_sentence_len) == 4.0


@pytest.mark.parametrize(("m", "want"), [(1, 0.10), (8, 1.0), (25, 1.0), (30, 0.90), (60, 0.30)])
def test_sentence_score(spark: SparkSession, m: int, want: float) -> None:
    assert spark.range(1).select(T.sentence_score(F.lit(float(m)))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(("r", "want"), [(0.0, 0.40), (0.20, 1.0), (0.55, 1.0), (0.80, 0.20)])
def test_stopword_score(spark: SparkSession, r: float, want: float) -> None:
    assert spark.range(1).select(T.stopword_score(F.lit(r))).first()[0] == pytest.approx(want)


def test_quality(spark: SparkSession) -> None:
    for t in ("", "  \n", None, "∑∫∂≈→∞"):
        q = value(spark, t, T.quality)
        assert q["quality_score"] == 0.0 and q["flagged"]
    assert value(spark, "", T.quality)["nonascii_ratio"] == 1.0
    one = value(spark, "a", T.quality)
    assert one["quality_score"] == 0.40 and not one["flagged"]
    good = value(spark, "CUDA warp scheduler hides memory latency through context switching.", T.quality)
    assert good["quality_score"] > 0.75 and not good["flagged"]
    bad = value(spark, "的的的的的 abc. 的的的的. de.", T.quality)
    assert bad["nonascii_ratio"] > 0.40 and bad["flagged"]


def test_small_ones(spark: SparkSession) -> None:
    def one(f, t: str) -> object:
        return value(spark, t, f)

    assert one(T.footer_query_id, "x query_id: `ab12` y") == "ab12" and one(T.footer_query_id, "none") is None
    assert one(T.passage_label, "[Doc 1]  text") == "Doc 1" and one(T.without_label, "[Doc 1]  text") == "text" and one(T.passage_label, "text") is None
    assert [one(T.reaction, r) for r in ("thumbsup", "thumbsdown", "heart")] == ["up", "down", None]
    assert [one(T.request_stage, p) for p in ("/search/x", "/", "")] == ["search", "root", "root"]
    assert one(lambda c: T.snippet(c, 5, "…"), " a  b\nc d ") == "a b c…"
    import hashlib

    assert one(T.document_key, "u") == hashlib.sha256(b"u").hexdigest()[:16]
    key: Column = T.chunk_key(F.lit("d"), F.lit(3), F.lit("é" * 80))
    assert spark.range(1).select(key).first()[0] == hashlib.sha256(("d:3:" + "é" * 64).encode()).hexdigest()[:24]
