"""Maps the given tables to the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import quality, tokens
from corvane.sources.store import spread, stored


#: Tables of texts: what is done to a row costs far more than moving it.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage is a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id, label 1 where a document holds the query's passage: the query set against all rows.

    A word inside a passage (not its first or last) is a whole word of any document that holds it. So each passage is looked for only where its
    rarest such word is: an equi-join. Passages of fewer than three words have none, and are compared with all texts.
    """
    asked = queries(spark, sf_dir).where("query is not null")
    words = F.split("query", " ")
    inner = asked.select("query_id", "query", F.explode(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).alias("word")).where("word <> ''")
    held = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    held = stored(held.join(inner.select("word").distinct(), "word"), "heldwords")
    df = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    anchor = inner.join(df, "word", "left").groupBy("query_id", "query").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    near = held.join(anchor, "word").select("doc_id", "query_id", "query").join(docs(spark, sf_dir), "doc_id").where(F.contains("text", "query"))
    short = asked.join(anchor.select("query_id"), "query_id", "left_anti")
    found = near.select("query_id", "doc_id")
    if not short.isEmpty():
        found = found.unionByName(docs(spark, sf_dir).join(short, F.contains("text", "query")).select("query_id", "doc_id"))
    return found.select("query_id", "doc_id", F.lit(1).alias("label"))


def counted_qrels(spark: SparkSession, sf_dir: str, counts: DataFrame, terms: DataFrame) -> DataFrame:
    """As ``qrels``, from the counted terms of documents (doc_id, nos) and the queries' terms (term, no, df; a null df is 0), which a search has anyway.

    A document that holds a passage holds the tokens of its inner words, so it is looked for where its rarest such token is. The pairs are stored, so that where
    they are few the texts need no shuffle. Passages without such a token are compared with all texts.
    """
    asked = queries(spark, sf_dir).where("query is not null")
    words = F.split("query", " ")
    inner = asked.select("query_id", F.explode(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).alias("word"))
    inner = inner.select("query_id", F.explode(tokens(F.col("word"))).alias("term")).join(terms.select("term", "no", "df").distinct(), "term")
    anchor = stored(inner.groupBy("query_id").agg(F.min_by("no", F.struct(F.coalesce("df", F.lit(0)), "no")).alias("no")), "anchors")
    near = stored(counts.select("doc_id", F.explode("nos").alias("no")).join(anchor, "no").select("query_id", "doc_id"), "nearpairs")
    found = docs(spark, sf_dir).join(near, "doc_id").join(asked, "query_id").where(F.contains("text", "query")).select("query_id", "doc_id")
    rest = asked.join(anchor.select("query_id"), "query_id", "left_anti")
    if not rest.isEmpty():
        found = found.unionByName(docs(spark, sf_dir).join(rest, F.contains("text", "query")).select("query_id", "doc_id"))
    return found.select("query_id", "doc_id", F.lit(1).alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose identifier is divisible by 100."""
    return vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def vector_labels(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """``ranked`` with label: vectors of the query's label are relevant (1), the query's own vector most (2), others 0."""
    asked = vector_queries(spark, sf_dir).select("query_id", F.col("label").alias("asked"))
    rows = ranked.join(vectors(spark, sf_dir).select("vec_id", F.col("label").alias("own")), "vec_id", "left").join(asked, "query_id", "left")
    relevant = F.when(F.col("vec_id") == F.col("query_id"), 2).otherwise(1)
    return rows.withColumn("label", F.when(F.col("own") == F.col("asked"), relevant).otherwise(0)).drop("own", "asked")


def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, label, n: how many vectors of each relevance a query has."""
    sizes = vectors(spark, sf_dir).groupBy("label").count()
    asked = vector_queries(spark, sf_dir).select("query_id", "label").join(sizes, "label")
    each = F.array(F.struct(F.lit(2).alias("label"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(1).alias("label"), (F.col("count") - 1).alias("n")))
    return asked.select("query_id", F.explode(each).alias("x")).select("query_id", "x.label", "x.n")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), "lang").alias("title"), F.col("lang").alias("gpu_family"), F.col("source").alias("doc_type"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))


def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), quality(F.col("text")).alias("q")).select("chunk_id", "q.*")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, day, user_id, stage, duration_ms, query_id and the reaction that a click or an error stands for."""
    e = table(spark, sf_dir, "events")
    reaction = F.when(F.col("event_type") == "click", "up").when(F.col("event_type") == "error", "down")
    return e.select(
        "event_id", "ts", F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"),
        F.get_json_object("props", "$.k").alias("query_id"), reaction.alias("reaction"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("reaction is not null")


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled document is a judgment; its source is the query it belongs to."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.select("doc_id", F.col("source").alias("query_id"), (F.col("quality") == 1).alias("supported"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a document, a turn a page; its role is the page's heading."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("heading"), "text")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric (event type), day, score (mean value to six places)."""
    return events(spark, sf_dir).groupBy(F.col("stage").alias("metric"), "day").agg(F.round(F.avg("duration_ms"), 6).alias("score"))
