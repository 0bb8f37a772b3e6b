"""Line-first quality rules (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import GAP, SPACE, WORD, let

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# Fixed values of the line rules.
END_MARKS = r"[.!?…。！？][\"'»”’)\]]*\s*$"
MENU_MARKS = "|»›•·>"
BOILERPLATE = (
    r"\b(cookies?|privacy policy|terms of (use|service)|all rights reserved|copyright|javascript|lorem ipsum|subscribe|newsletter|sign (in|up)|log ?in"
    r"|skip to (main )?content|click here|read more|share (this|on)|powered by)\b"
)
MENU_WORDS = r"^\s*(home|about( us)?|contact( us)?|login|menu|search|next|previous|back|sitemap|faq|help|top)\s*$"


@dataclass(frozen=True)
class LineRules:
    """Bounds of the line rules; shares are of a line's characters or words."""

    short_line_words: int = 10  # boilerplate phrases and missing end marks count against lines of fewer words only
    max_symbol_share: float = 0.10  # characters of SYMBOLS
    max_menu_share: float = 0.20  # menu marks for each word
    max_shout_share: float = 0.50  # exclamation marks for each word
    max_lost_share: float = 0.50  # of a text's characters, before it is rejected


def _without(text: Column, chars: str) -> Column:
    """``text`` without ``chars``; a chain of ``replace`` is several times as fast as ``translate``."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def words_of(text: Column) -> Column:
    """The words of ``text`` as an array; empty for blank."""
    return let(F.btrim(text, F.lit(SPACE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)))


def repeated_window_words(words: Column, size: int = WINDOW) -> Column:
    """How many of ``words`` lie in a window of ``size`` words that occurs twice or more.

    Windows are compared by a 64-bit digest. They are sorted with their places, so that equal ones are
    neighbours: n log n for long texts. The places found are sorted back and their spans joined.
    """

    def from_hashes(h: Column) -> Column:
        every = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))
        windows = F.slice(every, F.lit(1), F.size(h) - size + 1)

        def covered(w: Column) -> Column:
            placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def places(s: Column) -> Column:
                twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
                at = F.array_sort(F.transform(twice, lambda x: x["i"]))

                def spans(p: Column) -> Column:
                    steps = F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size))))
                    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

                return let(at, spans)

            return let(placed, places)

        def some(w: Column) -> Column:
            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))

        return let(windows, some)

    return F.when(F.size(words) < size, F.lit(0)).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), from_hashes))


def _line_words(line: Column) -> Column:
    """The words of a line; where single spaces are all that parts them, they are counted by the spaces, which is far faster."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in SPACE[1:]:
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd | (line == ""), F.regexp_count(line, F.lit(WORD))).otherwise(_count(line, " ") + 1)


def _line_fails(line: Column, rules: LineRules) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rules remove."""
    low = F.lower(line)

    def judge(n: Column) -> Column:
        short = n < rules.short_line_words
        return (
            (short & ~line.rlike(END_MARKS))
            | (_count(line, SYMBOLS) > rules.max_symbol_share * F.length(line))
            | (_count(line, MENU_MARKS) > rules.max_menu_share * n)
            | (_count(line, "!") > rules.max_shout_share * n)
            | (short & low.rlike(MENU_WORDS))
            | (short & low.rlike(BOILERPLATE))
        )

    return let(_line_words(line), judge)


def _counts(text: Column, rules: LineRules, clean: bool) -> Column:
    """All measures of one text in one struct, its words split once and its lines split and judged once; with ``clean`` also the text without failing lines."""
    def by_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), repeated_window_words(w).alias("n_repeat_words"))

    def judge(line: Column) -> Column:
        blank = F.btrim(line, F.lit(SPACE)) == ""
        return F.struct(line.alias("x"), blank.alias("blank"), (~blank & _line_fails(line, rules)).alias("fails"))

    def by_lines(lines: Column) -> Column:
        def size(some: Column) -> Column:
            return F.aggregate(some, F.lit(0), lambda a, s: a + F.length(s["x"]))

        def of(full: Column) -> Column:
            lost = size(F.filter(full, lambda s: s["fails"]))
            alike = F.size(full) - F.size(F.array_distinct(F.transform(full, lambda s: s["x"])))
            return F.struct(alike.alias("n_dup_lines"), lost.alias("lost_chars"), size(full).alias("line_chars"))

        measures = let(F.filter(lines, lambda s: ~s["blank"]), of)
        if not clean:
            return F.struct(measures.alias("m"))
        left = F.array_join(F.transform(F.filter(lines, lambda s: ~s["fails"]), lambda s: s["x"]), "\n")
        return F.struct(measures.alias("m"), left.alias("clean"))

    return F.struct(
        let(words_of(text), by_words).alias("w"),
        let(F.transform(F.split(text, "\n"), judge), by_lines).alias("l"),
        F.length(_without(text, SPACE)).alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
    )


def quality(docs: DataFrame, text_col: str = "text", rules: LineRules | None = None, clean_col: str | None = None) -> DataFrame:
    """Adds the base counts, the lines' loss and the verdict to ``docs``; no shuffle, one row for each row.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), lost_share (double, of the characters of
    lines with a word), base_failed and kept (boolean); columns of these names are replaced, others pass through. ``clean_col`` names a further column
    (it may be ``text_col``) for the text without the lines that fail: line order, line ends and blank lines stay.
    Each line is judged first; a text that loses more than ``max_lost_share`` of its characters
    is rejected. A null, empty or blank text has counts of 0 and fails the base rule.
    """
    rules = rules or LineRules()
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_share", "base_failed", "kept")
    own = [c for c in docs.columns if c not in added]
    got = docs.select(*own, let(F.coalesce(F.col(text_col), F.lit("")), lambda t: _counts(t, rules, clean_col is not None)).alias("_q"))
    n, rep = F.col("_q.w.n_words"), F.col("_q.w.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
    share = F.coalesce(F.col("_q.l.m.lost_chars") / F.nullif(F.col("_q.l.m.line_chars"), F.lit(0)), F.lit(0.0))
    lost = share > rules.max_lost_share
    cleaned = [F.col("_q.l.clean").alias(clean_col)] if clean_col else []
    return got.select(
        *[c for c in own if c != clean_col], *cleaned,
        n.cast("long").alias("n_words"), F.col("_q.word_chars").cast("long").alias("word_chars"),
        F.col("_q.n_symbols").cast("long").alias("n_symbols"), F.col("_q.l.m.n_dup_lines").cast("long").alias("n_dup_lines"),
        rep.cast("long").alias("n_repeat_words"), share.alias("lost_share"),
        failed.alias("base_failed"), (~failed & ~lost).alias("kept"),
    )


def cleaned_text(text: Column, rules: LineRules | None = None) -> Column:
    """``text`` without the lines that fail (line order, line ends and blank lines stay)."""
    rules = rules or LineRules()
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: (F.btrim(x, F.lit(SPACE)) == "") | ~_line_fails(x, rules)), "\n")
