"""Text measures as column expressions: no Python functions, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words of low information.
STOPWORDS = (
    "a about above after all also an and any are as at be been being both but by can could did do does during each every few for from had has have how "
    "if in into is it its just may might more most no not of on only or other own same should so some such than that the then there these this those "
    "through to too use used using very was were what when where which who will with would"
).split()
FLAG_THRESHOLD = 0.40
# (?U): the word border must know letters of every script, on any Java version.
TOKEN = r"(?U)\b[a-zA-Z0-9_]+\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row (a lambda variable is not inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores between word borders, of the lower-cased text.

    Where every character is one byte, all borders are those of the runs, and a plain pattern finds the same far faster.
    """
    found = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    return let(F.lower(text), lambda t: F.when(F.octet_length(t) == F.length(t), found(t, "[a-z0-9_]+")).otherwise(found(t, TOKEN)))


def nonascii_ratio(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"[\x00-\x7F]+", "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def stopword_ratio(toks: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.coalesce(F.size(F.filter(toks, lambda t: F.array_contains(stop, t))) / F.nullif(F.size(toks), F.lit(0)), F.lit(0.0))


def mean_sentence_len(text: Column) -> Column:
    """Mean tokens of a sentence; sentences end at white space after an end mark. Without sentences: the token count."""
    parts = F.filter(F.split(text, r"(?U)(?<=[.!?])\s+", -1), lambda s: s.rlike(r"(?U)\S"))

    def mean(s: Column) -> Column:
        total = F.aggregate(F.transform(s, lambda x: F.size(tokens(x))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(s) == 0, F.size(tokens(text)).cast("double")).otherwise(total / F.nullif(F.size(s), F.lit(0)))

    return let(parts, mean)


def sentence_score(m: Column) -> Column:
    return (
        F.when(m < 3, 0.10).when(m < 8, 0.50 + (m - 3) * 0.08).when(m <= 25, 1.0).when(m <= 50, 1.0 - (m - 25) * 0.020).otherwise(0.30)
    )


def stopword_score(r: Column) -> Column:
    return F.when(r < 0.10, 0.40).when(r < 0.20, 0.70).when(r <= 0.55, 1.0).when(r <= 0.75, 1.0 - (r - 0.55) * 2.0).otherwise(0.20)


def quality(text: Column) -> Column:
    """A struct: quality_score (0 to 1), mean_sent_len, nonascii_ratio, stopword_ratio, flagged.

    Null and blank texts score 0 with a non-ASCII ratio of 1; texts without tokens score 0 with their own ratio.
    """

    def of(toks: Column) -> Column:
        def shape(s: Column) -> Column:
            raw = 0.40 * sentence_score(s["m"]) + 0.30 * F.greatest(F.lit(0.0), 1.0 - s["n"] * 6.0) + 0.30 * stopword_score(s["s"])
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw, 4)))
            return _result(score, F.round(s["m"], 2), F.round(s["n"], 4), F.round(s["s"], 4))

        none = _result(F.lit(0.0), F.lit(0.0), nonascii_ratio(text), F.lit(0.0))
        parts = F.struct(mean_sentence_len(text).alias("m"), nonascii_ratio(text).alias("n"), stopword_ratio(toks).alias("s"))
        return F.when(F.size(toks) == 0, none).otherwise(let(parts, shape))

    blank = _result(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    return F.when(text.isNull() | ~text.rlike(r"(?U)\S"), blank).otherwise(let(tokens(text), of))


def _result(score: Column, sent: Column, nonascii: Column, stop: Column) -> Column:
    return F.struct(
        score.alias("quality_score"), sent.cast("double").alias("mean_sent_len"), nonascii.cast("double").alias("nonascii_ratio"),
        stop.cast("double").alias("stopword_ratio"), (score < FLAG_THRESHOLD).alias("flagged"),
    )


def snippet(text: Column, size: int = 150, ellipsis: str = "") -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit(ellipsis))).otherwise(flat)


def passage_label(text: Column) -> Column:
    """The label of a passage that begins with ``[label]``, or null."""
    return F.nullif(F.regexp_extract(text, r"^\[([^\]]+)\]\s*", 1), F.lit(""))


def without_label(text: Column) -> Column:
    return F.regexp_replace(text, r"^\[([^\]]+)\]\s*", "")


def footer_query_id(text: Column) -> Column:
    """The identifier in a ``query_id: `…` `` footer, or null."""
    return F.nullif(F.regexp_extract(text, r"query_id:\s*`([A-Za-z0-9]+)`", 1), F.lit(""))


def reaction(name: Column) -> Column:
    """up or down for the two reaction names that are tracked, else null."""
    return F.when(name == "thumbsup", "up").when(name == "thumbsdown", "down")


def request_stage(path: Column) -> Column:
    """The first segment of a request path, or root."""
    return F.coalesce(F.nullif(F.get(F.split(F.btrim(path, F.lit("/")), "/"), F.lit(0)), F.lit("")), F.lit("root"))


def context(passages: Column) -> Column:
    """``[id] text`` of each passage struct (chunk_id, text), parted by blank lines."""
    return F.array_join(F.transform(passages, lambda p: F.concat(F.lit("["), p["chunk_id"].cast("string"), F.lit("] "), p["text"])), "\n\n")


def document_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def chunk_key(document: Column, index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(document, F.lit(":"), index.cast("string"), F.lit(":"), F.substring(text, 1, 64)), 256), 1, 24)
