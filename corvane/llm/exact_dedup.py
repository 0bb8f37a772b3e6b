"""Exact deduplication by content sort (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, shared_dir, shuffle_width

#: Rows drawn (about) to find texts so frequent that one task should not hold them all.
SAMPLE_ROWS = 20_000
#: Characters of a text that the range splitters see; bounds what sampling sends to the driver.
SPLITTER_CHARS = 64
#: Into how many ranges a hot text may be cut.
HOT_SALTS = 64


def _hot_texts(keyed: DataFrame, parts: int) -> list[str]:
    """Digests of texts that hold more than half of a partition's share of a sample.

    At most ``2 * parts`` can pass, so the list is bounded by the width of the shuffle.
    Missing one only makes a task larger; results do not depend on it.
    """
    total = keyed.count()
    drawn = keyed.sample(fraction=min(1.0, SAMPLE_ROWS / max(total, 1)), seed=7)
    least = max(20, min(total, SAMPLE_ROWS) // (2 * parts))
    found = drawn.groupBy("_sha").count().where(F.col("count") >= least).orderBy(F.desc("count"), "_sha")
    return [r["_sha"] for r in found.limit(2 * parts).collect()]


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Marks, of every group of equal texts, the one row that stays.

    Texts are equal when they are identical after lower-casing A-Z only; a null text
    counts as empty. Sampled splitters range-partition the normalised texts, each
    partition is sorted (Spark's external sort spills to disk), so that equal texts are
    neighbours, and neighbours are compared in full. A text that a sample shows to be
    hot is cut into several ranges; what its parts hold together is one aggregate by digest and text, summed before it is shuffled.

    Adds ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the normalised
    UTF-8 text) to the columns of ``docs``; other columns pass through, columns of those
    four names are replaced. ``keep`` is "smallest" or "largest" identifier. A null
    identifier loses against any other. Where several rows share text and identifier,
    exactly one of them is kept. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    spark = docs.sparkSession
    shared_dir(spark)
    parts = shuffle_width(spark)
    best = F.max if keep == "largest" else F.min
    first = F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_last()
    own = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    hot = _hot_texts(docs.select(F.sha2(norm, 256).alias("_sha")), parts)
    keyed = docs.select(*own, F.col(id_col).alias("_id"), norm.alias("_norm")).withColumn("_sha", F.sha2("_norm", 256))
    deal = lambda i: F.pmod(F.xxhash64(i), F.lit(HOT_SALTS))
    salt = F.when(F.col("_sha").isin(hot), deal(F.col("_id"))) if hot else F.lit(None).cast("long")
    keyed = keyed.withColumn("_salt", F.coalesce(salt, F.lit(0).cast("long"))).withColumn("_head", F.substring("_norm", 1, SPLITTER_CHARS))
    # Ranges of (_head, _sha, _salt) are coarser than the window's keys: no second exchange follows. The digest parts texts with one beginning.
    same = Window.partitionBy("_head", "_sha", "_salt", "_norm")
    ranged = keyed.repartitionByRange(parts, "_head", "_sha", "_salt")
    near = (
        ranged.withColumn("_n", F.count(F.lit(1)).over(same))
        .withColumn("_nth", F.row_number().over(same.orderBy(first)))
        .withColumn("_best", F.first("_id").over(same.orderBy(first)))
        .drop("_norm", "_head")
    )
    if not hot:
        return near.select(
            *own, F.col("_best").alias("keep_id"), F.col("_n").alias("group_size"),
            (F.col("_nth") == 1).alias("kept"), F.col("_sha").alias("text_sha256"),
        )
    # hot texts as such: rows with one digest must have one text, and a part is home to the row that stays if its identifier is dealt there
    whole = keyed.where(F.col("_sha").isin(hot)).groupBy("_sha", "_norm").agg(best("_id").alias("_whole"), F.count(F.lit(1)).alias("_all")).drop("_norm")
    whole = whole.groupBy("_sha").agg(best("_whole").alias("_whole"), F.max("_all").alias("_all"), F.count(F.lit(1)).alias("_texts"))
    one_text = F.when(F.col("_texts") == 1, F.col("_all")).otherwise(F.raise_error(F.lit("two texts of one digest")).cast("long"))
    whole = whole.select("_sha", "_whole", one_text.alias("_all"), deal(F.col("_whole")).alias("_home"))
    out = near.join(F.broadcast(whole), "_sha", "left")  # 2 * parts rows at most
    cut = F.col("_all").isNotNull()
    return out.select(
        *own,
        F.when(cut, F.col("_whole")).otherwise(F.col("_best")).alias("keep_id"),
        F.coalesce("_all", "_n").alias("group_size"),
        ((F.col("_nth") == 1) & (~cut | (F.col("_salt") == F.col("_home")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
