from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.quality_lines import cleaned_text, quality
from tests.llm.conftest import awkward_rows, prose


def base(text: str | None) -> tuple:
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(awkward: DataFrame, nothing: DataFrame) -> None:
    got = sorted((tuple(r) for r in quality(awkward).select("doc_id", *COLUMNS).collect()), key=str)
    assert got == sorted(((r[0], *base(r[1])) for r in awkward_rows()), key=str)
    assert quality(nothing).collect() == []


def test_repeats_overlap_and_count_each_word_once(spark: SparkSession) -> None:
    texts = ["a b c d e a b c d e", "a a a a a a a", "x " * 4 + "y", "a b c d e f " + prose(1, 30) + " a b c d e f", "p q r s t u p q r s t v p q r s t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality(df).collect()}
    assert got == {i: base(t)[4] for i, t in enumerate(texts)}


def test_lines_decide(spark: SparkSession) -> None:
    good = "This is a sentence that says something in ten words. Then another one follows it, as is usual."
    texts = {
        "clean": good + "\nQuite another line with its own words stands here.\nShort end.",
        "menu": " | ".join(f"item{i}" for i in range(30)),
        "shout": " ".join(f"WORD{i}!!" for i in range(30)),
        "symbols": " ".join(f"word{i}###" for i in range(30)),
        "frame": good + "\n" + "\n".join(["Home", "About us", "Cookies"] * 20),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: r["kept"] for r in quality(df).collect()}
    assert got == {"clean": True, "menu": False, "shout": False, "symbols": False, "frame": False}
    text = spark.createDataFrame([(good + "\nHome\n" + good,)], "t string").select(cleaned_text(F.col("t"))).first()[0]
    assert text == good + "\n" + good


def test_a_lines_words_are_runs_whatever_parts_them(spark: SparkSession) -> None:
    seven, ten = ["w" + c for c in "abcdefg"], ["w" + c for c in "abcdefghij"]
    lines = ["  ".join(seven) + "  ", "\t".join(ten), " ".join(ten), "\t".join(seven)]  # no end mark: only a line of ten words or more stays
    text = spark.createDataFrame([("\n".join(lines),)], "t string").select(cleaned_text(F.col("t"))).first()[0]
    assert text == "\n".join(lines[1:3])


def test_the_clean_column_is_the_cleaned_text(awkward: DataFrame) -> None:
    want = awkward.select(F.coalesce("text", F.lit("")).alias("t")).select(cleaned_text(F.col("t")).alias("c")).collect()
    got = quality(awkward, clean_col="text").select("text").collect()
    assert sorted(r["text"] for r in got) == sorted(r["c"] for r in want)
    assert quality(awkward, clean_col="key").columns.count("key") == 1
