"""Latency of injected steps as columns: time taken in the task, waits left out, merged as exact counts by bucket."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Clock = Callable[[], float]
#: Buckets of a histogram: a bucket's bounds differ by this factor, so a percentile read from it is right to half of that.
GROWTH = 1.02


class Stopwatch:
    """Seconds of work on a clock. ``wait`` runs what is not to be counted: a pause for a rate limit, a queue."""

    def __init__(self, clock: Clock = time.perf_counter) -> None:
        self.clock, self.waited = clock, 0.0

    def wait(self, pause: Callable[[], object]) -> None:
        began = self.clock()
        pause()
        self.waited += self.clock() - began

    def timed(self, work: Callable[[], object]) -> tuple[object, float]:
        """What ``work`` gives, and the milliseconds that it took without its waits."""
        self.waited, began = 0.0, self.clock()
        got = work()
        return got, 1000 * (self.clock() - began - self.waited)


def timed_rows(rows: DataFrame, key: str, text: str, step: Callable[[str, Stopwatch], str], clock: Callable[[], Clock] = lambda: time.perf_counter) -> DataFrame:
    """key, result, latency_ms: ``step`` of each row's text (null stays null and takes no time), with the time that it took.

    ``clock`` makes a task's clock; each row is timed in the task that works on it, so what Spark does between rows is not counted. The result is a column of data like
    any other: written out once, it stays as it is (a stage that Spark runs again is timed again).
    """
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        watch = Stopwatch(clock())
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"], strict=True):
                got, ms = (None, 0.0) if t is None else watch.timed(lambda t=t: step(t, watch))
                out.append((k, got, ms))
            yield pd.DataFrame(out, columns=["k", "result", "latency_ms"])

    found = rows.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, "k string, result string, latency_ms double")
    return found.select(F.col("k").cast(kind).alias(key), "result", "latency_ms")


def bucket(ms: Column) -> Column:
    """The number of the bucket of a latency: those of up to a thousandth of a millisecond share bucket 0."""
    return F.when(ms <= 0.001, 0).otherwise(F.ceil(F.log(ms / 0.001) / math.log(GROWTH))).cast("int")


def histogram(rows: DataFrame, keys: list[str], ms: str = "latency_ms") -> DataFrame:
    """keys, bucket, n, total_ms: exact counts. Histograms of different runs add up (``merged``); null latencies are left out."""
    return rows.where(F.col(ms).isNotNull()).groupBy(*keys, bucket(F.col(ms)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("total_ms"))


def merged(*histograms: DataFrame, keys: list[str]) -> DataFrame:
    rows = histograms[0]
    for h in histograms[1:]:
        rows = rows.unionByName(h)
    return rows.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total_ms").alias("total_ms"))


def summary(histograms: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """keys, n, mean_ms (exact) and p95_ms: the middle of the bucket that holds the row at that share of the ranks (1 + share * (n - 1), rounded up).

    A key has at most about 1,200 buckets between a microsecond and an hour, so its rows fit a task however many latencies there were.
    """
    rows = histograms.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total_ms").alias("total"), F.array_sort(F.collect_list(F.struct("bucket", F.col("n").alias("m")))).alias("h"))
    wanted = F.ceil(1 + share * (F.col("n") - 1) - 1e-9)
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("at"))

    def step(a: Column, x: Column) -> Column:
        seen = a["seen"] + x["m"]
        return F.struct(seen.alias("seen"), F.when((a["at"] < 0) & (seen >= wanted), x["bucket"]).otherwise(a["at"]).alias("at"))

    at = F.aggregate("h", zero, step, lambda a: a["at"])
    middle = F.when(F.col("_at") == 0, 0.0).otherwise(0.001 * F.pow(F.lit(GROWTH), F.col("_at") - 0.5))
    return rows.withColumn("_at", at).select(*keys, "n", (F.col("total") / F.col("n")).alias("mean_ms"), middle.alias("p95_ms"))


def with_latency(benchmark: DataFrame, timed: DataFrame, keys: tuple[str, ...] = ("config", "query_id")) -> DataFrame:
    """Benchmark rows with latency_ms; a row that was not timed has null."""
    return benchmark.join(timed.select(*keys, "latency_ms"), list(keys), "left")
