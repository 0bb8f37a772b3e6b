"""WARC archives: writing captures, reading records, assembling transactions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import stored

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "2024-01-01T00:00:00Z"
#: Captures in one archive file, so that a file fits a reading task.
CAPTURES_PER_FILE = 20_000
#: Groups of equal payloads that are sent to every executor (about 100 bytes each); more are joined by a salted shuffle.
BROADCAST_GROUPS = 500_000
SALTS = 32
#: Stands for a missing identifier; no encoded one has this character.
NO_PAGE = "~"

RECORD = "file string, place long, record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, http string, payload_bytes long, payload_sha1 string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes."""
    digest = F.sha1(payload)
    parts = [F.conv(F.substring(digest, 1 + 10 * j, 10), 16, 10).cast("long") for j in range(4)]
    chars = [F.substring(F.lit(BASE32), F.shiftright(p, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for p in parts for i in range(8)]
    return F.concat(*chars)


def mark_revisits(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers``: the (page_id, uid) of the response of equal payload that this capture revisits, or null.

    ``captures`` has page_id, uid (unique), bytes, digest. Of equal payloads of at least ``min_bytes`` the one with the largest page_id
    (then uid) is the response. The groups are found with map-side aggregation, so a payload that a third of all rows share
    is one row from each task; only groups of two or more are joined back, by broadcast while there are few and by salted shuffle else.
    """
    groups = captures.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.max(F.struct("page_id", "uid")).alias("kept"), F.count(F.lit(1)).alias("n")
    )
    groups = stored(groups.where("n > 1").drop("n"), "revisits")
    if groups.count() <= BROADCAST_GROUPS:
        joined = captures.join(F.broadcast(groups), "digest", "left")
    else:
        spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = captures.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(spread, ["digest", "salt"], "left").drop("salt")
    other = F.col("kept").isNotNull() & (F.col("kept.uid") != F.col("uid")) & (F.col("bytes") >= min_bytes)
    return joined.withColumn("refers", F.when(other, F.col("kept"))).drop("kept")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(VERSION + END)]
    for name, value in headers:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise(""))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block)


def _urn(page: Column, uid: Column, part: str = "") -> Column:
    return F.concat(F.lit("<urn:page:"), _spelt(page), F.lit(":"), uid.cast("string"), F.lit(f"{part}>"))


def _spelt(page: Column) -> Column:
    """An identifier of any type as one word; ``NO_PAGE`` for null."""
    return F.coalesce(F.url_encode(page.cast("string")), F.lit(NO_PAGE))


def _read_page(word: Column, kind: str) -> Column:
    return F.when(~word.isin("", NO_PAGE), F.url_decode(word)).when(word == "", F.lit("")).cast(kind)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """Writes gzip WARC files: for each row a response or revisit record with its concurrent request and metadata records.

    The payload is the page in UTF-8; null counts as empty. A revisit has the HTTP header of its page and no payload. Spark's text writer
    commits the files, each record ends with the blank lines of the format, and a null URL leaves the target out. A header value's line
    ends become spaces.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    flat = F.regexp_replace(F.col(url_col), r"[\r\n]+", " ")
    captures = pages.select(F.col(id_col).alias("page_id"), flat.alias("url"), html.alias("html")).select(
        "page_id", "url", "html", F.monotonically_increasing_id().alias("uid"), F.octet_length("html").cast("long").alias("bytes"), base32_sha1(F.col("html")).alias("digest")
    )
    captures = stored(captures, "captures")  # numbers the rows once
    judged = mark_revisits(captures, min_bytes)
    own = _urn(F.col("page_id"), F.col("uid"))
    url, digest = F.col("url"), F.concat(F.lit("sha1:"), F.col("digest"))
    is_revisit = F.col("refers").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    common = [("WARC-Target-URI", url), ("WARC-Date", F.lit(EPOCH))]
    capture = _record(
        [("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest),
         ("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))), ("WARC-Refers-To", F.when(is_revisit, _urn(F.col("refers.page_id"), F.col("refers.uid")))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html"))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.col("page_id"), F.col("uid"), ":request")), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1), F.lit("/")), F.lit(f" HTTP/1.1{END}{END}")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.col("page_id"), F.col("uid"), ":metadata")), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page_id: "), _spelt(F.col("page_id")), F.lit(END)),
    )
    rows = judged.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", END + END).option("maxRecordsPerFile", 3 * CAPTURES_PER_FILE).text(path)


def _records(name: str, content: bytes, bodies: bool = True) -> Iterator[tuple]:
    """The records of one archive, one after another; a block's length comes from its header, so any bytes may stand in it."""
    source = io.BytesIO(content)
    stream = gzip.GzipFile(fileobj=source) if content[:2] == b"\x1f\x8b" else source
    place = 0
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: record {place} does not begin with a version line")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            head[key.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError(f"{name}: record {place} is cut short")
        http, payload = None, block
        if head.get("content-type", "").startswith("application/http"):
            first, gap, payload = block.partition(b"\r\n\r\n")
            http = first.decode("utf-8", "replace")
        digest = head.get("warc-payload-digest")
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kept = payload if bodies or head.get("warc-type") != "response" else None
        yield (name, place, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-concurrent-to"), head.get("warc-refers-to"),
               head.get("warc-target-uri"), digest.removeprefix("sha1:") if digest else None, http, len(payload), sha1, kept)
        place += 1


def read_archive(spark: SparkSession, path: str, batch_bytes: int = 8 << 20, bodies: bool = True) -> DataFrame:
    """One row for each record of the WARC files (plain or gzip, of any name) in ``path``.

    payload_bytes and payload_sha1 are taken from the whole payload as it is read; without ``bodies`` the payloads of responses are measured so and not sent on.
    Files are dealt to tasks by Spark's ``binaryFile`` reader, so any store that Spark reads will do; a task holds one compressed file and
    sends rows on in batches of about ``batch_bytes``. A damaged archive fails the read.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                held = 0
                for r in _records(name, bytes(content), bodies):
                    rows.append(r)
                    held += len(r[-1] or b"") + 200
                    if held >= batch_bytes:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture (response or revisit record): record_id, capture, requests, metadata.

    ``capture`` is the record as a struct; ``requests`` and ``metadata`` are the arrays of the records that name it in
    WARC-Concurrent-To, in order of place, empty where there is none. Records that name no capture, or one that the
    archive lacks, are left out, as are captures without an identifier. Repeated identifiers stay repeated rows.
    """
    whole = F.struct("file", "place", "record_id", "type", "refers_to", "target_uri", "payload_digest", "http", "payload_bytes", "payload_sha1", "payload")
    captures = records.where(F.col("type").isin("response", "revisit") & F.col("record_id").isNotNull()).select("record_id", whole.alias("capture"))
    beside = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    part = F.struct("file", "place", "record_id", "http", "payload")
    beside = beside.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", part))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", part))).alias("metadata"),
    )
    none = F.array().cast(beside.schema["requests"].dataType)
    out = captures.join(beside, "record_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("requests", "metadata")})


def capture_digests(captures: DataFrame, kind: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of assembled captures; identifiers are of type ``kind``.

    The page comes from the metadata record; a response's size and digest are those of the payload that was read, a revisit's
    those of its headers, as it has no payload. A capture without metadata has a null page.
    """
    field = F.regexp_extract(F.get("metadata", F.lit(0))["payload"].cast("string"), r"(?m)^page_id: (\S*)\s*$", 1)
    field = F.when(F.size("metadata") > 0, field)
    size = F.regexp_extract(F.col("capture.http"), r"(?im)^content-length: (\d+)\s*$", 1)
    revisit = F.col("capture.type") == "revisit"
    return captures.select(
        _read_page(field, kind).alias("page_id"),
        F.when(revisit, size.cast("long")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("capture.payload_digest")).otherwise(F.col("capture.payload_sha1")).alias("payload_digest"), F.col("capture.type").alias("record_type"),
        F.when(revisit, _read_page(F.regexp_extract("capture.refers_to", r"^<urn:page:([^:]*):", 1), kind)).alias("refers_to"),
    )
