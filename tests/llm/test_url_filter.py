from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import url_filter
from corvane.llm.queries import RULES
from corvane.llm.url_filter import judge_urls, listed_hits

URLS = [
    (1, "http://a.com/en/1"), (2, "https://X.Example.COM/en/71?q#f"), (3, "https://example.com/en/7"), (4, "https://notexample.com/en/7"), (5, "http://b.net/de/"),
    (6, "http://example.net/de/80"), (7, "http://c.org/es/x"), (8, "http://org/es/"), (9, None), (10, ""), (11, "no scheme/en/"), (12, "://h?x://y"),
    (13, "http://spam.io/p/?utm_source=a&b=2&a=1#z"), (13, "http://www.spam.io:80/p?a=1&b=2"), (14, "http://spam.io/p?a=1"), (15, "ftp://com/en/"),
]


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, u, "x", "y") for i, u in URLS], "page_id long, url string, host string, canonical string")


def test_rules_and_list(spark: SparkSession) -> None:
    listed = spark.createDataFrame([("spam.io/p?a=1&b=2",), ("spam.io/p?a=1&b=2",), (None,), ("c.org/es/x",)], "canonical string")
    got = sorted((tuple(r) for r in judge_urls(frame(spark), listed, RULES).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    want = [
        (1, "a.com", "/en/1", "com/en/", "block"), (2, "x.example.com", "/en/71", "example.com/en/7", "allow"), (3, "example.com", "/en/7", "example.com/en/7", "allow"),
        (4, "notexample.com", "/en/7", "com/en/", "block"), (5, "b.net", "/de/", "net/de/", "allow"), (6, "example.net", "/de/80", "example.net/de/8", "block"),
        (7, "c.org", "/es/x", "org/es/", "block"), (8, "org", "/es/", "org/es/", "block"), (9, "", "", None, "allow"), (10, "", "", None, "allow"), (11, "", "", None, "allow"),
        (12, "h", "", None, "allow"), (13, "spam.io", "/p/", None, "block"), (13, "www.spam.io:80", "/p", None, "block"), (14, "spam.io", "/p", None, "allow"), (15, "com", "/en/", "com/en/", "block"),
    ]
    assert got == sorted(want, key=str)


def test_filter_has_no_false_negatives_and_few_false_positives(spark: SparkSession, monkeypatch) -> None:
    listed = spark.range(3000).selectExpr("concat('u', id * 2) as k")
    urls = spark.range(6000).selectExpr("concat('u', id) as k", "id")
    for limit in (url_filter.BROADCAST_BYTES, 0):  # 0: the filter is joined by shuffle
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
        got = listed_hits(urls, listed, "k")
        assert got.count() == 6000
        assert got.where("is_listed <> (id % 2 = 0)").count() == 0
        assert got.where("is_listed and not is_possible").count() == 0
        assert got.where("is_possible and not is_listed").count() < 60


def test_empty(spark: SparkSession) -> None:
    none = spark.createDataFrame([], "canonical string")
    assert judge_urls(frame(spark).limit(0), none, RULES).collect() == []
    assert judge_urls(frame(spark), none, []).where("verdict = 'block'").count() == 0
