from __future__ import annotations

import random
import re
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession

from corvane.llm.html_text import extract, lines_of, main_text

LONG = "A rather long paragraph that makes the distribution rise over the threshold at once."


def test_article_only() -> None:
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>Home</li></ul></nav><div class='ad'>{LONG}</div><article><h1>A &amp; B</h1><p>One\n two<p>Three<br>four<script>var x='</p>';</script></article><footer>{LONG}</footer>"
    assert main_text(page) == "A & B One two Three four"


def test_without_an_article_element() -> None:
    page = f"""<body class="has-sidebar"><header>Site</header><div id="content"><h2>Title</h2><p>{LONG}</p><div class="cookie-notice">ok?</div><p>Next &lt;b&gt;&nbsp; end.</p>
    <form><input><button>Go</button></form><ul><li>i<li>j</ul></div><aside>{LONG}</aside><div class="comments"><p>{LONG}</p></div><footer>f</footer></body>"""
    assert main_text(page) == f"Title {LONG} Next <b> end. i j"


def test_the_larger_run_outside_an_article_survives() -> None:
    teaser = "<article><h3>Read this too</h3></article>"
    assert main_text(f"<body><nav>n</nav><div><p>{LONG}<p>{LONG}</div><nav>n</nav>{teaser}") == f"{LONG} {LONG}"  # a short run dives
    assert main_text(f"<div><p>{LONG}{teaser}<p>End.</div>") == f"{LONG} Read this too End."  # one run, nothing parts it
    assert main_text(f"<main><p>{LONG}</main><nav>n</nav><div><p>{LONG}<p>{LONG}</div>") == f"{LONG} {LONG} {LONG}"
    assert main_text(f"<div>{LONG}</div><article><p>{LONG}<p>One<nav>n</nav><p>Two</article>") == f"{LONG} One Two"  # the article is the larger, and its last words stay
    assert main_text("<div>Not much text here, 37 characters.</div><article>Less</article>") == "Less"  # no surge outside


def test_broken_and_empty_pages() -> None:
    assert main_text(None) == main_text("") == main_text("<nav>only a menu") == ""
    assert main_text("<article>cut of<b>f <p class='ad'>buy</p>here<") == "cut off here<"
    assert main_text('<article><a href="x>y">t</a> a < b</article>') == "t a < b"
    assert main_text("<article><!-- <p>no</p> -->yes<noscript>n</noscript></article>") == "yes"


def test_operator_keeps_rows_and_columns(spark: SparkSession) -> None:
    rows = [(1, None, "a"), (1, "<article>é𝄞</article>", "b"), (None, "", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = extract(df)
    assert got.columns == ["page_id", "html", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, "", 0), (1, "é𝄞", 2)]
    assert extract(df.limit(0)).collect() == []


def kept_lines(page: str, window: int = 3, surge: int = 40) -> list[str]:
    """The distribution once more, line by line, for pages without an article element."""
    lines = [t for t, _ in lines_of(page)]
    block = [sum(map(len, lines[i : i + window])) for i in range(len(lines))]
    out = []
    for i, t in enumerate(lines):
        a = b = i
        while a > 0 and block[a - 1]:
            a -= 1
        while b + 1 < len(block) and block[b + 1]:
            b += 1
        if t and block[i] and max(block[a : b + 1]) >= min(surge, max(block) / 2):
            out.append(t)
    return out


def test_the_distribution_against_brute_force() -> None:
    r = random.Random(4)
    for _ in range(300):
        parts = ["<nav>menu</nav>" if r.random() < 0.4 else f"<p>{'w ' * r.randint(1, 30)}</p>" for _ in range(r.randint(0, 12))]
        page = f"<body>{''.join(parts)}</body>"
        assert main_text(page) == " ".join(kept_lines(page))


def test_the_distribution_decides_inside_an_article() -> None:
    page = f"<article><p>{LONG}</p><nav>x</nav><p>Tags: a, b</p><nav>y</nav><p>{LONG}</p></article>"
    assert " ".join(t for t, inside in lines_of(page) if t and inside) == f"{LONG} Tags: a, b {LONG}"  # all lines of the article
    assert main_text(page) == f"{LONG} {LONG}"
    assert main_text("<article><p>Short.</p></article>") == "Short."  # the highest block there is


def test_an_article_keeps_its_short_last_words() -> None:
    assert main_text(f'<article><p>{LONG}</p><div class="nav">m</div><p>End.</p></article>') == f"{LONG} End."
    assert main_text(f"<div><p>{LONG}</p></div><nav>m</nav><p>Tail.</p>") == LONG  # without the element it is a run like others


def test_names_that_take_most_of_a_page_are_not_heeded() -> None:
    assert main_text(f'<div class="banner-story"><p>{LONG}</p></div><p>x</p>') == f"{LONG} x"
    assert main_text(f'<div id="promotion-policy-article"><p>{LONG}<p>{LONG}</div><nav>menu</nav>') == f"{LONG} {LONG}"
    assert main_text(f'<div class="banner">{LONG} {LONG}</div><article>News.</article>') == "News."  # the element holds text
    assert main_text(f'<p>{LONG}</p><div class="banner">Buy.</div>') == LONG
    assert main_text(f"<nav>{LONG} {LONG}</nav><p>{LONG}</p>") == LONG


PAGES = Path("/root/testdata/sf0.01/pages.parquet")


@pytest.mark.skipif(not PAGES.exists(), reason="the test tables are not here")
def test_given_pages_without_their_article_element() -> None:
    pages = [h for h in pq.read_table(PAGES)["html"].to_pylist() if h]
    bare = [re.sub(r"<(/?)(?:article|main)\b", r"<\1div", h) for h in pages]
    assert all(h != b for h, b in zip(pages, bare, strict=True))
    assert [main_text(h) for h in pages] == [main_text(b) for b in bare]


def test_time_does_not_explode() -> None:
    begun = time.monotonic()
    for page in ("<![CDATA[" * 100_000, "<a " * 100_000, "<div>" * 50_000 + "</section>" * 50_000, "<p>x " * 100_000, "<!-- " * 100_000, "<![CDATA[ x > y" * 50_000 + "]]>"):
        main_text(page)
    assert time.monotonic() - begun < 20
    assert main_text(f"<p>{LONG} " * 5_000) == " ".join([LONG] * 5_000)
    assert main_text("<p>a <![CDATA[ b < c ]]> d</p><![CDATA[ e > f") == "a b < c d f"
