from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from corvane.llm import warc
from corvane.llm.warc import capture_digests, read_archive, transactions, write_archive

ROWS = [
    (1, "http://a/x?y", "<p>one</p>"), (2, "http://b\r\nEvil: 1", "<p>one</p>"), (3, None, None), (4, "http://d", ""), (5, "e", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\nüß"),
    (6, "f", "x" * 100_000), (6, "f", "x" * 100_000), (None, "g", "alone"),
]


def expected(min_bytes: int) -> list[tuple]:
    out = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = [j for j, _, g in ROWS if (g or "").encode() == data and j is not None]
        best = max(same) if same else None
        revisit = len(data) >= min_bytes and i != best
        out.append((i, len(data), digest, "revisit" if revisit else "response", best if revisit else None))
    return out


@pytest.mark.parametrize("min_bytes", [0, 12])
@pytest.mark.parametrize("limit", [warc.BROADCAST_GROUPS, 0])
def test_round_trip(spark: SparkSession, tmp_path: Path, min_bytes: int, limit: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", limit)
    df = spark.createDataFrame([(*r, "a", 1) for r in ROWS], "page_id long, url string, html string, digest string, uid int").repartition(3)
    path = f"file://{tmp_path}/w"
    write_archive(df, path, min_bytes=min_bytes)
    records = read_archive(spark, path)
    assert records.count() == 3 * len(ROWS)
    captures = transactions(records).cache()
    assert captures.where("size(requests) <> 1 or size(metadata) <> 1").count() == 0
    got = sorted((tuple(r) for r in capture_digests(captures).collect()), key=str)
    assert got == sorted((tuple(r) for r in capture_digests(transactions(read_archive(spark, path, bodies=False))).collect()), key=str)
    want = expected(min_bytes)
    # of repeated rows exactly one is the response; a lone null identifier is a response
    twice = [r for r in want if r[0] == 6]
    want = [r for r in want if r[0] not in (6, None)] + [twice[0], (*twice[0][:3], "revisit", 6)] + [(None, 5, want[-1][2], "response", None)]
    assert got == sorted(want, key=str)
    bodies = {r["t"] for r in captures.where("capture.type = 'response'").selectExpr("cast(capture.payload as string) t").collect()}
    assert bodies == {h or "" for _, _, h in ROWS}


def test_damage_fails_and_empty_is_empty(spark: SparkSession, tmp_path: Path) -> None:
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert transactions(read_archive(spark, f"file://{tmp_path}/e")).collect() == []
    with pytest.raises(ValueError, match="cut short"):
        list(warc._records("f", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError, match="version line"):
        list(warc._records("f", b"nonsense\r\n"))


def test_assembly_by_concurrent_to(spark: SparkSession) -> None:
    row = lambda i, kind, to: ("f", 0, i, kind, to, None, None, None, None, 0, None, None)
    rows = [row("<r>", "response", None), row("<q>", "request", "<r>"), row("<m>", "metadata", "<r>"), row("<m2>", "metadata", "<r>"), row("<l>", "request", "<lost>"), row("<s>", "revisit", None), row(None, "response", None), row("<w>", "warcinfo", None)]
    got = {r["record_id"]: (len(r["requests"]), len(r["metadata"])) for r in transactions(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got == {"<r>": (1, 2), "<s>": (0, 0)}


def test_string_identifiers_and_any_file_name(spark: SparkSession, tmp_path: Path) -> None:
    ids = ["a b:c>d", "", None, "null", "~"]
    df = spark.createDataFrame([(i, "u", f"<p>{k % 2}</p>") for k, i in enumerate(ids)], "page_id string, url string, html string")
    write_archive(df, f"file://{tmp_path}/w")
    (tmp_path / "other").mkdir()
    for k, f in enumerate(sorted((tmp_path / "w").glob("part-*"))):
        f.rename(tmp_path / f"other/crawl-{k}.warc.gz")
    got = {r["page_id"]: r["refers_to"] for r in capture_digests(transactions(read_archive(spark, f"file://{tmp_path}/other")), "string").collect()}
    assert got == {"a b:c>d": "~", "": "null", None: "~", "null": None, "~": None}
