"""URL filtering with host and path rules, a blocked Bloom filter and an exact join."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, stored

# Parameters of a query string that only track the visitor.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: 64-bit words of one block; a key sets one bit in each.
BLOCK_WORDS = 8
#: Bits of the filter for each listed URL, before rounding up to blocks.
BITS_PER_KEY = 16
#: Largest filter, and largest list, in bytes, that is sent to every executor; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Ways into which a block of the filter, or a listed URL, is dealt in such a shuffle, so that a popular URL is not one task's.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One spelling for URLs that name one page: no scheme, fragment, default port,
    ``www.``, tracking parameters or trailing slash; parameters sorted. Null stays null."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?|/+)$", "")
    query = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits, or nulls.

    A rule fits its host and all subdomains when the path starts with the rule's.
    Rules of equal length that fit the same URL keep the order of ``rules``.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """For each word of a block the one bit that ``key`` sets."""
    h = F.xxhash64(key, F.lit(23))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 7 * i), F.lit(64)).cast("int")) for i in range(BLOCK_WORDS)]


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def build_filter(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A blocked Bloom filter as a table: one row for each block, 8 words of 64 bits.

    Built by a distributed ``bit_or``; about ``BITS_PER_KEY`` bits a key, so a URL that is
    not listed passes in well under one case in a hundred, and a listed one always does.
    """
    keys = listed.count()
    blocks = max(1, -(-keys * BITS_PER_KEY // (64 * BLOCK_WORDS)))
    bits = _bits(F.col(key))
    rows = listed.select(_block(F.col(key), blocks).alias("_block"), *[b.alias(f"_w{i}") for i, b in enumerate(bits)])
    return rows.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(BLOCK_WORDS)]), blocks


def listed_hits(urls: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """``urls`` with ``is_possible`` (the Bloom filter's answer) and ``is_listed`` (exact).

    Only possible hits take part in the exact hash join; a null key is never listed. Filter and list are
    broadcast, and ``urls`` scanned once, while their sizes, which are known, stay within ``BROADCAST_BYTES``. Larger ones are joined
    by shuffles on the block number and on the URL, both salted by a digest of the row. ``listed`` may repeat keys.
    """
    listed = stored(listed.select(key).where(F.col(key).isNotNull()).distinct(), "urlkeys")
    bloom, blocks = build_filter(listed, key)
    size = listed.agg(F.sum(F.octet_length(key))).first()[0] or 0
    row = F.xxhash64(*urls.columns)  # deals rows without a key to all blocks
    probed = urls.withColumn("_block", F.coalesce(F.when(F.col(key).isNotNull(), _block(F.col(key), blocks)), F.pmod(row, F.lit(blocks))))
    salt = F.pmod(row, F.lit(SALTS)).cast("int")
    if blocks * 8 * BLOCK_WORDS <= BROADCAST_BYTES:
        probed = probed.join(F.broadcast(bloom), "_block", "left")
    else:
        probed = probed.withColumn("_salt", salt).join(_salted(bloom), ["_block", "_salt"], "left").drop("_salt")
    hit = reduce(lambda a, b: a & b, [F.col(f"_w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(F.col(key)))])
    probed = probed.withColumn("is_possible", F.coalesce(hit & F.col(key).isNotNull(), F.lit(False)))
    probed = probed.drop("_block", *[f"_w{i}" for i in range(BLOCK_WORDS)])
    sure = listed.select(F.col(key).alias("_hit"), F.lit(True).alias("is_listed"))
    if size + 16 * blocks * 64 * BLOCK_WORDS // BITS_PER_KEY <= BROADCAST_BYTES:
        out = probed.withColumn("_hit", F.when(F.col("is_possible"), F.col(key))).join(F.broadcast(sure), "_hit", "left").drop("_hit")
    else:
        hits = probed.where("is_possible").withColumn("_hit", F.col(key)).withColumn("_salt", salt)
        hits = hits.join(_salted(sure), ["_hit", "_salt"], "left").drop("_hit", "_salt")
        out = hits.unionByName(probed.where(~F.col("is_possible")).withColumn("is_listed", F.lit(False)))
    return out.withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Judges every row's URL: the longest fitting rule decides, else the list does.

    ``listed`` has the canonical URLs to block in a column ``canonical``. Returns ``id_col``, host, path,
    rule, verdict, canonical, is_possible and is_listed, one row for each row of ``pages``; repeated rows
    stay repeated. A null URL or one without ``://`` has an empty host and path and, unless a rule fits,
    is allowed. Other columns of ``pages`` are not read.
    """
    urls = pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), canonical(F.col(url_col)).alias("canonical"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    seen = listed_hits(urls, listed, "canonical")
    return seen.select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "canonical", "is_possible", "is_listed",
    )


def spam_listing(pages: DataFrame, labels: list[str], url_col: str = "url") -> DataFrame:
    """The canonical URLs whose host has one of ``labels`` as a label: a block list from a crawl."""
    host = host_of(F.col(url_col))
    found = pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels))))
    return stored(found.select(canonical(F.col(url_col)).alias("canonical")).distinct(), "urllist")
