"""Main text of HTML pages by the line-block distribution."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How elements are treated.
BREAKS = (
    "address article blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "hr html li main ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()
DROPPED = (
    "head script style noscript template svg math iframe object canvas audio video select button form nav footer header aside menu dialog textarea"
).split()
BARE_TEXT = "script style textarea title xmp noscript iframe".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
ASIDE_WORDS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent notice notices "
    "alert popup modal overlay sidebar side-bar sidebars rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination "
    "pager toc footer foot header masthead topbar toolbar share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login comment comments commentlist disqus respond reply replies skip hidden copyright disclaimer"
).split()
STATE_WORDS = "no with has without".split()  # "no-sidebar" tells of a page's layout and names no sidebar
WHOLE = "html body main article".split()
OPTIONAL_END = "p li dt dd tr td th option".split()
ASIDE_ROLES = "navigation banner contentinfo complementary search alert dialog menu menubar toolbar".split()

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
_NO_CDATA = re.compile(_TOKEN.pattern.replace(r"<!\[CDATA\[(.*?)\]\]>|", "(?!)()|"), re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_BREAKS, _DROPPED, _VOID, _BARE = map(frozenset, (BREAKS, DROPPED, VOID, BARE_TEXT))
_ASIDE, _ROLES, _STATE, _WHOLE, _OPTIONAL = map(frozenset, (ASIDE_WORDS, ASIDE_ROLES, STATE_WORDS, WHOLE, OPTIONAL_END))
#: Empty lines that stand for a removed part of the page's frame: as wide as a window, so that the distribution falls to zero there.
#: What stands within an article (an advert, a notice, a form, a script) is removed without a trace, and does not part the text around it.
GAP_LINES = 3
FRAME = "nav header footer aside menu".split()
FRAME_WORDS = (
    "sidebar side-bar sidebars rail nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc footer foot header masthead topbar "
    "related recommended recommendations comment comments commentlist disqus respond reply replies"
).split()


def _is_frame(name: str, attrs: str) -> bool:
    return name in FRAME or any(set(FRAME_WORDS).intersection(re.split(r"[-_\s\"']+", v.lower())) for _, v in _ATTR.findall(attrs))


def _is_aside(attrs: str) -> bool:
    """True if an element's class, id or role says that it is not part of the article."""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                words = re.split(r"[-_]+", token)
                if token in _ASIDE or words[0] not in _STATE and _ASIDE.intersection(words):
                    return True
    return False


def lines_of(page: str, names: bool = True) -> list[tuple[str, bool]]:
    """Strips markup: one (text, inside the article element) for each block. Without ``names``, what classes, identifiers and roles say of an element is not heeded."""
    return _read(page, names)[0]


def _read(page: str, names: bool) -> tuple[list[tuple[str, bool]], int]:
    """The lines, and how many characters of text went because of elements' names alone.

    Removed parts of the page's frame leave ``GAP_LINES`` empty lines. A paragraph's open tag also ends the one before;
    an element that is never closed ends with the one that holds it or with the page. Time grows with the page's length, whatever is left open.
    """
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, removed, article
    at, end = 0, len(page)
    last_tag, last_cdata = page.rfind(">"), page.rfind("]]>")
    opened: Counter[str] = Counter()  # names on the stack
    removed = article = frame = named = False
    lost = 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((text, article))

    def close_to(depth: int) -> None:
        nonlocal removed, article
        flush()
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]
        was, removed = removed, bool(stack) and stack[-1][1]
        article = bool(stack) and stack[-1][2]
        if was and not removed and frame:
            out.extend([("", article)] * GAP_LINES)

    while at < end:
        m = (_TOKEN if at < last_cdata else _NO_CDATA).search(page, at) if at <= last_tag or page.find("<!--", at) >= 0 else None
        if not removed:
            parts.append(page[at : m.start() if m else end])
        elif named:
            lost += len(page[at : m.start() if m else end].strip())
        if not m:
            break
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1] and not removed:
                parts.append(m[1])
            continue
        if m[2]:  # a close tag
            if opened[name] > 0:
                close_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name in _BREAKS and not removed:
                flush()
            continue
        if stack and name in _BREAKS and name != "br" and stack[-1][0] in _OPTIONAL and (stack[-1][0] == "p" or stack[-1][0] == name):
            close_to(len(stack) - 1)  # a block ends an open paragraph, a list item the one before
        if name in _BREAKS and not removed:
            flush()
        if name in _VOID or m[4].endswith("/"):
            continue
        drop = removed or name in _DROPPED or names and name not in _WHOLE and _is_aside(m[4])
        if drop and not removed:
            flush()
            named = name not in _DROPPED
            frame = _is_frame(name, m[4])
        if name in _BARE:  # raw text up to its own close tag
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if drop and (not removed or name not in _OPTIONAL) or name in _BREAKS and name not in _OPTIONAL:
            removed, article = drop, article or name in ("article", "main")
            stack.append((name, removed, article))
            opened[name] += 1
    flush()
    return out, lost


def _runs(size: list[int], window: int) -> list[tuple[int, int, int]]:
    """(first line, line after the last, highest block) of each run of non-zero blocks."""
    block = [sum(size[i : i + window]) for i in range(len(size))]
    out = []
    i = 0
    while i < len(block):
        dive = i
        while dive < len(block) and block[dive]:
            dive += 1
        if dive > i:
            out.append((i, dive, max(block[i:dive])))
        i = dive + 1
    return out


def main_text(page: str | None, window: int = 3, surge: int = 40) -> str:
    """The text between surge and dive points of the line-block distribution.

    Block i is the text length of lines i .. i + window - 1. The text starts at the first line of a run of
    non-zero blocks that surges and ends where the distribution dives to zero. A run surges with a block of ``surge`` characters or, where the whole
    distribution stays low, of half its highest block. Where the page has
    an ``article`` or ``main`` element with text, runs inside and outside are told apart: if no run outside that reaches
    ``surge`` is larger than the largest inside, the runs inside are the distribution; else the
    element does not hold the main text, and the distribution over all lines decides as if it were not there. The last run inside is kept even if it is
    short: a removed part may stand before an article's last words. Where no such element has text and the names of elements took more text than they left, names are not heeded:
    a wrapper may be called after what it is not.
    """
    if not page:
        return ""
    lines, lost = _read(page, True)
    if lost > sum(len(t) for t, _ in lines) and not any(t and a for t, a in lines):
        lines = lines_of(page, names=False)
    size = [len(t) for t, _ in lines]
    inside = [n if a else 0 for n, (_, a) in zip(size, lines, strict=True)]
    if any(inside):
        outside = [n - m for n, m in zip(size, inside, strict=True)]
        rival = max((sum(outside[i:dive]) for i, dive, top in _runs(outside, window) if top >= surge), default=0)
        if rival <= max(sum(inside[i:dive]) for i, dive, _ in _runs(inside, window)):
            size = inside
    runs = _runs(size, window)
    least = min(surge, max((top for _, _, top in runs), default=0) / 2)
    last = runs[-1][0] if runs and size is inside else -1
    return " ".join(t for i, dive, top in runs if top >= least or i == last for (t, _), n in zip(lines[i:dive], size[i:dive], strict=True) if n)


def extract(pages: DataFrame, html_col: str = "html", window: int = 3, surge: int = 40) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to ``pages``, one row for each row.

    A null or empty page gives an empty text. Other columns pass through; columns named ``text`` or ``n_chars`` are replaced.
    No shuffle: every page is read in the task that scanned it.
    """

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, window, surge) for p in batch], dtype=object)

    found = F.pandas_udf(texts, "string")
    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    if html_col not in own:
        raise ValueError(f"{html_col!r} would be replaced by the result")
    return pages.select(*own, found(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
