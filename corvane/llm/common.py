"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.store import discard, shared_dir, spread, stored

__all__ = ["ascii_lower", "bucketed", "discard", "let", "shared_dir", "shuffle_width", "stored", "table"]

# The six characters that separate words, and the ASCII letters.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` would also change other scripts).

    Where every character is one byte ``lower`` does just that, and faster.
    """
    return let(col, lambda c: F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row.

    A plain reference inside a lambda is inlined by the optimizer and computed
    again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``stored``, in buckets by ``key``: later joins on the key with as many partitions move the other side only."""
    at = uuid.uuid4().hex
    own = f"corvane_{name}_{at}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(df.sparkSession)}/corvane-{name}-{at}").saveAsTable(own, format="parquet")
    out = df.sparkSession.table(own)
    df.sparkSession.sql(f"DROP TABLE {own}")  # of the catalog only: the files are the shared folder's, and ``out`` knows them
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
