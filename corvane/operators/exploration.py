"""Tables for exploration by SQL: named views of whatever can be loaded, and a drift history to look at before there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Loader = Callable[[], DataFrame]
# The columns of the benchmark table that are explored.
BENCHMARK_COLUMNS = "config query_id ndcg_at_10 mrr prec_at_3 prec_at_5 prec_at_10 latency_ms cost_usd".split()


def register_views(loaders: dict[str, Loader]) -> dict[str, str]:
    """Makes a temporary view of each loader's rows, under its name; returns the reasons of those that failed, by name. The others are there all the same.

    Rows are looked at once, so that a source that cannot be read fails here and not in the middle of a session.
    """
    failed = {}
    for name, load in loaders.items():
        try:
            rows = load()
            rows.limit(1).collect()
            rows.createOrReplaceTempView(name)
        except Exception as e:  # the boundary of a loader: whatever it raises costs its own view alone
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return failed


def benchmark_view(rows: DataFrame) -> DataFrame:
    """The columns that exploration knows; those that a run did not measure are null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in BENCHMARK_COLUMNS])


def drift_history(spark: SparkSession, last: str, days: int = 14, seed: int = 5) -> DataFrame:
    """date, psi (0 to 0.4, about 0.1) and num_shifted_terms (0 to 7) of the ``days`` up to ``last``: made up, the same for each seed, day by day.

    A day's numbers follow from a digest of seed and date, so longer histories hold the shorter ones.
    """
    rows = spark.range(days).select(F.date_sub(F.to_date(F.lit(last)), (F.lit(days - 1) - F.col("id")).cast("int")).alias("date"))
    draw = lambda n: F.pmod(F.xxhash64(F.lit(seed), "date", F.lit(n)), F.lit(1_000_003)) / 1_000_003
    bell = sum((draw(i) for i in range(12)), F.lit(0.0)) - 6  # the sum of twelve even draws is close to a normal one
    return rows.select(F.col("date"), F.round(F.least(F.greatest(0.10 + 0.05 * bell, F.lit(0.0)), F.lit(0.4)), 4).alias("psi"), F.floor(8 * draw(99)).cast("int").alias("num_shifted_terms"))
