"""A BM25 index that is kept up to date: segments of postings, tombstones, and statistics that are sums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import sparse, sparse_lists
from corvane.sources.snapshots import SnapshotTable
from corvane.sources.store import discard, stored


def statistics_of(df: DataFrame, totals: DataFrame) -> DataFrame:
    """term, df, idf, avgdl as ``sparse.statistics`` gives them, from document frequencies (term, df) and one row of totals (n, words)."""
    raw = df.where("df > 0").crossJoin(F.broadcast(totals)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # totals is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    out = raw.crossJoin(F.broadcast(mean))  # one row
    return out.select("term", "df", F.when(F.col("raw") < 0, sparse.EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), (F.col("words") / F.col("n")).alias("avgdl"))


class LiveIndex:
    """Postings, documents and statistics of a changing collection, each a table of versioned snapshots below one folder.

    A change (``apply``) writes a segment: the postings of new texts (a row for each document, as ``sparse_lists.packed`` gives them), a row (doc_id, dl) for each document that came, tombstones (doc_id) for those that were replaced or
    removed, and what the change adds to or takes from each term's document frequency. Nothing that is there is rewritten. A posting is alive if no tombstone of a later
    segment names its document. Statistics are sums over all segments, so they equal those of an index built anew. ``compact`` makes one segment of all.

    The table of segments is written last, by one swap: rows that no segment names do not count. So a change shows whole or not at all, one that stopped half way may be applied
    again, and of two changes at the same time one is refused (``snapshots.Conflict``).
    """

    TABLES = ("postings", "documents", "tombstones", "frequencies", "segments")

    def __init__(self, spark: SparkSession, path: str, kind: str = "long") -> None:
        """``kind``: the type of document identifiers."""
        self.spark, self.kind = spark, kind
        self.tables = {n: SnapshotTable(spark, f"{path.rstrip('/')}/{n}") for n in self.TABLES}
        self.schemas = {
            "postings": f"doc_id {kind}, dl bigint, terms string, tfs array<int>, change string", "documents": f"doc_id {kind}, dl bigint, change string", "tombstones": f"doc_id {kind}, change string",
            "frequencies": "term string, df bigint, change string", "segments": "segment int, name string, change string, n bigint, words bigint",
        }

    def segments(self) -> DataFrame:
        """segment (its place in order), name of the change, and what it adds to the numbers of documents and words. A row for each change since the last compaction."""
        return self.tables["segments"].read(schema=self.schemas["segments"])

    def _rows(self, name: str) -> DataFrame:
        """The rows of all segments, with their place."""
        rows = self.tables[name].read(schema=self.schemas[name])
        return rows.join(F.broadcast(self.segments().select("change", "segment")), "change").drop("change")

    def _alive(self, name: str) -> DataFrame:
        return self._living(self._rows(name))

    def _living(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows``, which have their segments, that no later segment's tombstone names."""
        last = self._rows("tombstones").groupBy("doc_id").agg(F.max("segment").alias("gone"))
        rows = rows.join(last, "doc_id", "left")
        return rows.where(F.col("gone").isNull() | (F.col("segment") >= F.col("gone"))).drop("gone", "segment")

    def _write(self, parts: dict[str, DataFrame], change: str) -> None:
        for table, rows in parts.items():
            self.tables[table].commit(rows.select("*", F.lit(change).alias("change")), token=change)

    def apply(self, upserts: DataFrame | None = None, removals: DataFrame | None = None, name: str | None = None) -> int:
        """Brings in ``upserts`` (doc_id, text: new documents, and new texts of known ones) and takes out ``removals`` (doc_id). Returns the segment's number.

        ``upserts`` is read twice, once its identifiers alone. Rows without an identifier are left out; a document whose text is null can be listed, but counts in no statistic; of rows that share an identifier the greatest text counts; a document in both is removed and comes back with
        its new text; one that is not there is not removed. A change whose ``name`` was applied already does nothing.
        """
        base = self.tables["segments"].snapshot().version
        change = uuid.uuid4().hex
        name = name or change
        done = self.segments().where(F.col("name") == name).select("segment").first()
        if done:
            return done["segment"]
        segment = 1 + (self.segments().agg(F.max("segment")).first()[0] or 0)
        empty = self.spark.createDataFrame([], f"doc_id {self.kind}, text string")
        new = (upserts if upserts is not None else empty).where("doc_id is not null").select("doc_id", "text")
        twice = stored(new.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "sharedids")
        if not twice.isEmpty():  # else no text needs to move
            shared = new.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
            new = new.join(twice, "doc_id", "left_anti").unionByName(shared)
        self._write({"postings": sparse_lists.packed(new)}, change)  # once: what follows reads the table
        postings = self.tables["postings"].read(schema=self.schemas["postings"]).where(F.col("change") == change).drop("change")
        fresh = stored(postings.select("doc_id", "dl"), "documents")
        gone = fresh.select("doc_id")
        if removals is not None:
            gone = gone.unionByName(removals.select("doc_id").where("doc_id is not null")).distinct()
        old = stored(self._alive("documents").join(gone, "doc_id", "left_semi").select("doc_id", "dl"), "replaced")
        lost = self._living(self._rows("postings").join(old.select("doc_id"), "doc_id", "left_semi"))
        counted = [sparse_lists.frequencies(postings)]
        if not old.isEmpty():
            counted.append(sparse_lists.frequencies(lost).withColumn("df", -F.col("df")))
        df = counted[0] if len(counted) == 1 else counted[0].unionByName(counted[1]).groupBy("term").agg(F.sum("df").alias("df"))
        self._write({"documents": fresh, "tombstones": old.select("doc_id"), "frequencies": df.where("df <> 0")}, change)
        signed = fresh.select("dl", F.lit(1).alias("d")).unionByName(old.select("dl", F.lit(-1).alias("d")))
        totals = signed.where("dl is not null").agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.col("d") * F.col("dl")), F.lit(0)).cast("long").alias("words"))
        row = totals.select(F.lit(segment).cast("int").alias("segment"), F.lit(name).alias("name"), F.lit(change).alias("change"), "n", "words")
        self.tables["segments"].commit(self.segments().unionByName(row), token=change, mode="overwrite", base=base)
        for x in (twice, old, fresh):
            discard(x)
        return segment

    def compact(self) -> int:
        """One segment of all that is alive; returns its number. What it replaces stays on disk until ``clean``."""
        base, change = self.tables["segments"].snapshot().version, uuid.uuid4().hex
        segment = 1 + (self.segments().agg(F.max("segment")).first()[0] or 0)
        df = self._rows("frequencies").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        self._write({"postings": self._alive("postings"), "documents": self._alive("documents"), "frequencies": df}, change)
        totals = self.segments().agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.sum("words"), F.lit(0).cast("long")).alias("words"))
        row = totals.select(F.lit(segment).cast("int").alias("segment"), F.lit("compacted").alias("name"), F.lit(change).alias("change"), "n", "words")
        self.tables["segments"].commit(row, token=change, mode="overwrite", base=base)
        return segment

    def clean(self) -> None:
        """Rewrites the tables without rows that no segment names, and deletes old versions. No search or change may be under way."""
        known = F.broadcast(self.segments().select("change"))
        for name, table in self.tables.items():
            if name != "segments":
                table.commit(table.read(schema=self.schemas[name]).join(known, "change", "left_semi").select(*[c.split()[0] for c in self.schemas[name].split(", ")]), mode="overwrite")
            table.vacuum()

    def parts(self) -> dict[str, DataFrame]:
        """The index as one built anew has it: postings (as ``sparse_lists.packed``), statistics and documents."""
        df = self._rows("frequencies").groupBy("term").agg(F.sum("df").alias("df"))
        totals = self.segments().agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
        return {"postings": self._alive("postings"), "statistics": statistics_of(df, totals), "documents": self._alive("documents").select("doc_id")}

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank: the first k of each query, as an index built anew gives them."""
        numbers, wanted = sparse_lists.asked(sparse.query_terms(queries), self.parts()["statistics"])
        counts = stored(self._living(sparse_lists.counts_of(self._rows("postings"), numbers, ("segment",))), "termcounts")  # narrow before they meet tombstones
        return sparse_lists.lists(counts, wanted, k).where(F.col("list") == sparse_lists.BM25).select("query_id", "doc_id", "score", "rank")
