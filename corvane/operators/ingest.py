"""Ingestion: document assembly, chunking, upserts, coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import chunk_key
from corvane.sources.store import stored

# How texts are cut, how much of a piece is looked for, and the first bytes of a PDF.
CHUNK_SIZE, CHUNK_OVERLAP = 1500, 150
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
PROBE = 80
PDF_MAGIC = "255044462D"


def checked_files(files: DataFrame) -> DataFrame:
    """Adds is_pdf (by its first five bytes) and content_sha256 to rows of Spark's ``binaryFile`` source."""
    return files.withColumn("is_pdf", F.substring("content", 1, 5) == F.unhex(F.lit(PDF_MAGIC))).withColumn("content_sha256", F.sha2("content", 256))


def require_all(manifest: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``manifest`` joined with ``found``; a manifest row without a file is an error when the rows are read."""
    rows = manifest.join(found.withColumn("_hit", F.lit(True)), key, "left")
    lost = F.raise_error(F.concat(F.lit("missing from the download: "), F.col(key).cast("string"))).cast("boolean")
    return rows.where(F.when(F.col("_hit").isNull(), lost).otherwise(True)).drop("_hit")


def download_report(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """``key`` and status of every document of the manifest: ok, or download_failed if there is no file of it or the file is not what it should be (is_pdf)."""
    found = files.groupBy(key).agg(F.bool_or("is_pdf").alias("_ok"))
    return manifest.select(key).join(found, key, "left").select(key, F.when(F.coalesce("_ok", F.lit(False)), "ok").otherwise("download_failed").alias("status"))


def heading_spans(spans: DataFrame) -> DataFrame:
    """Page texts and headings from (doc_id, page, span_no, text, size, flags): large or bold short spans are headings."""
    heading = ((F.col("size") >= 12) | (F.col("flags").bitwiseAND(16) != 0)) & (F.length("text") < 120)
    ordered = F.array_sort(F.collect_list(F.struct("span_no", "text", heading.alias("h"))))
    pages = spans.groupBy("doc_id", "page").agg(ordered.alias("s"))
    return pages.select(
        "doc_id", "page", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"),
        F.transform(F.filter("s", lambda x: x["h"]), lambda x: x["text"]).alias("headings"),
    )


def page_offsets(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", heading: str = "heading") -> DataFrame:
    """Adds part (``[heading]`` line and text, where there is a heading) and char_offset of the part in the assembled document."""
    part = F.when(F.coalesce(F.col(heading), F.lit("")) != "", F.concat(F.lit("["), F.col(heading), F.lit("]\n"), F.col(text))).otherwise(F.col(text))
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumn("part", part)
    return rows.withColumn("char_offset", F.coalesce(F.sum(F.length("part") + 2).over(before), F.lit(0)).cast("long"))


def assembled(parts: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """full_text of each document: its parts in page order, parted by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct(page, "part")))
    return parts.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda s: s["part"]), "\n\n").alias("full_text"))


def nearest_heading(positions: DataFrame, headings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds heading to (doc, pos): the last non-empty one at an offset of at most pos, else null.

    An as-of join by union and a running last value: one shuffle by document, no pairs.
    """
    left = positions.withColumn("_o", F.col("pos")).withColumn("_h", F.lit(None).cast("string")).withColumn("_side", F.lit(1))
    right = headings.where(F.coalesce("heading", F.lit("")) != "").select(doc, F.col("offset").alias("_o"), F.col("heading").alias("_h"), F.lit(0).alias("_side"))
    rows = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(doc).orderBy("_o", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last("_h", ignorenulls=True).over(order)).where("_side = 1").drop("_o", "_h", "_side")


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs, each with a tail of up to ``overlap`` of the one before.

    A separator stays at the start of what follows it; pieces that are too long are cut at finer ones.
    """
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep in separators else ()
    if sep:
        raw = text.split(sep)
        parts = [p for p in [raw[0], *[sep + r for r in raw[1:]]] if p]
    else:
        parts = list(text)
    out: list[str] = []
    run: list[str] = []

    def merge() -> None:
        held: list[str] = []
        total = 0
        for p in run:
            if total + len(p) > size and held:
                out.append("".join(held).strip())
                while held and (total > overlap or total + len(p) > size):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        if held:
            out.append("".join(held).strip())
        run.clear()

    for p in parts:
        if len(p) < size:
            run.append(p)
            continue
        merge()
        out.extend(split_text(p, size, overlap, finer) if finer else [p])
    merge()
    return [p for p in out if p]


def localised(text: str, parts: list[str], overlap: int = CHUNK_OVERLAP) -> list[int]:
    """Where each piece begins: its first characters are looked for from where the piece before lets it begin."""
    at, out = 0, []
    for p in parts:
        found = text.find(p[:PROBE], at)
        pos = found if found >= 0 else at
        out.append(pos)
        at = pos + max(len(p) - overlap, 1)
    return out


def chunk_documents(docs: DataFrame, doc: str = "doc_id", text: str = "full_text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, count: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc, chunk_index, pos, chunk_text, chunk_id and token_count of every piece of every document.

    The cut is sequential within a text, so it is a small Python helper for each row; all else is columns. ``count`` is the token counter (an injected
    BPE encoder); the default counts words and so differs from it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, t in zip(batch["d"], batch["t"], strict=True):
                parts = split_text(t or "", size, overlap)
                rows += [(name, i, at, p) for i, (at, p) in enumerate(zip(localised(t or "", parts, overlap), parts, strict=True))]
            yield pd.DataFrame(rows, columns=["d", "chunk_index", "pos", "chunk_text"])

    kind = docs.schema[doc].dataType
    rows = docs.select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t")).mapInPandas(run, "d string, chunk_index long, pos long, chunk_text string")
    counter = count or (lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long"))
    return rows.select(F.col("d").cast(kind).alias(doc), "chunk_index", "pos", "chunk_text", chunk_key(F.col("d"), F.col("chunk_index"), F.col("chunk_text")).alias("chunk_id"), counter(F.col("chunk_text")).alias("token_count"))


def emitted_chunks(texts: DataFrame, headings: DataFrame, doc: str = "doc_id", text: str = "full_text", **kw) -> DataFrame:
    """The rows of the chunk table: those of ``chunk_documents`` with section_heading, the last heading (doc, offset, heading) at or before where a piece begins."""
    rows = nearest_heading(chunk_documents(texts, doc, text, **kw), headings, doc)
    return rows.withColumnRenamed("heading", "section_heading")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, .. in the order of ``order``, by sorted range partitions and the sizes of those before; no task needs all rows."""
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order)
    placed = stored(ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33)), "numbered")
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # as many rows as partitions
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_p", "_first", "_before")


def upsert_vectors(stored_rows: DataFrame, incoming: DataFrame, key: str, name: str = "vec_id") -> DataFrame:
    """The collection after an upsert: known keys keep their place ``name`` and take the new values, new keys follow in order of ``key``."""
    values = [c for c in incoming.columns if c != key]
    known = incoming.join(stored_rows.select(key, name), key)
    kept = stored_rows.join(incoming.select(key), key, "left_anti")
    last = stored_rows.agg(F.coalesce(F.max(name), F.lit(-1)).alias("_last"))
    new = numbered(incoming.join(stored_rows.select(key), key, "left_anti"), key, name).crossJoin(F.broadcast(last))  # last is one row
    new = new.withColumn(name, F.col(name) + F.col("_last") + 1)
    columns = [key, name, *values]
    return kept.select(*columns).unionByName(known.select(*columns)).unionByName(new.select(*columns))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have the key, each column is the new value or, if that is null, the old one. Adds action: insert, update or keep."""
    values = [c for c in stored.columns if c != key]
    old = stored.select(key, *[F.col(c).alias(f"_o_{c}") for c in values], F.lit(True).alias("_old"))
    new = incoming.select(key, *values, F.lit(True).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").otherwise("update")
    return old.join(new, key, "full").select(key, *[F.coalesce(c, f"_o_{c}").alias(c) for c in values], action.alias("action"))


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The rows of ``incoming`` to append: one for each key that ``stored`` lacks."""
    return incoming.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def hash_drift(stored: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Keys whose content hash is known on both sides and differs."""
    rows = stored.select(key, F.col(content).alias("old_hash")).join(incoming.select(key, F.col(content).alias("new_hash")), key)
    return rows.where("old_hash <> new_hash")


def repaired_feedback(feedback: DataFrame, query_log: DataFrame) -> DataFrame:
    """Feedback rows to append: a query that the log lacks becomes null, a missing user anonymous, a missing source web."""
    known = query_log.select("query_id", F.lit(True).alias("_hit")).distinct()
    rows = feedback.join(known, "query_id", "left").withColumn("query_id", F.when(F.col("_hit"), F.col("query_id"))).drop("_hit")
    return rows.withColumns({"user_id": F.coalesce("user_id", F.lit("anonymous")), "source": F.coalesce("source", F.lit("web"))})


def coverage(manifest: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """One row: total_manifest, total_indexed, coverage_pct (0 without a manifest)."""
    rows = manifest.select(key).join(indexed.select(key, F.lit(1).alias("hit")).distinct(), key, "left")
    out = rows.agg(F.count(F.lit(1)).alias("total_manifest"), F.count("hit").alias("total_indexed"))
    pct = F.round(100.0 * F.col("total_indexed") / F.nullif(F.col("total_manifest"), F.lit(0)), 2)
    return out.withColumn("coverage_pct", F.coalesce(pct, F.lit(0.0)))


def missing(manifest: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    return manifest.select(key).join(indexed.select(key), key, "left_anti")


def stratified_sample(docs: DataFrame, forced: DataFrame, size: int, stratum: str, key: str, seed: str = "42") -> DataFrame:
    """Keys of about ``size`` rows: all of ``forced``, and of each stratum the share that it has in the rest, drawn by a digest of the key."""
    rest = docs.join(forced.select(key), key, "left_anti")
    n = docs.join(forced.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("held"))
    sizes = rest.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    total = rest.agg(F.count(F.lit(1)).alias("total"))
    want = sizes.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(total))  # one row each
    want = want.select(stratum, F.bround(F.greatest(F.lit(size) - F.col("held"), F.lit(0)) * F.col("n") / F.col("total"), 0).cast("long").alias("want"))
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed))), key)
    nth = rest.select(key, stratum).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size)  # so each task sends on at most ``size`` rows of a stratum
    drawn = nth.join(F.broadcast(want), stratum).where("nth <= want")
    return drawn.select(key, stratum).unionByName(docs.join(forced.select(key), key, "left_semi").select(key, stratum))
