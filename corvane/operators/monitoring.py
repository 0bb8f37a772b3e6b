"""Drift, term shift, decline streaks and feedback summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators.dense import centroid, project
from corvane.operators.quantiles import quantiles

EPSILON = 1e-4
SIGNIFICANT, MODERATE = 0.25, 0.10


def psi(baseline: DataFrame, current: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """One row: psi, baseline_size, current_size.

    Buckets end at the baseline's distinct quantiles (exact, interpolated), the outer ones open; each takes [edge, next). Every share gets EPSILON
    more. A constant baseline gives 0. An empty side is an error when the row is read.
    """
    edges = quantiles(baseline, value, [i / buckets for i in range(buckets + 1)]).select(F.array_distinct("q").alias("edges"))
    inner = edges.select(F.when(F.size("edges") < 2, F.array().cast("array<double>")).otherwise(F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("inner"), (F.size("edges") < 2).alias("constant"))
    rows = baseline.select(F.lit(0).alias("side"), F.col(value).cast("double").alias("x")).unionByName(current.select(F.lit(1).alias("side"), F.col(value).cast("double").alias("x")))
    at = F.size(F.filter("inner", lambda e: e <= F.col("x")))
    counts = rows.where("x is not null").crossJoin(F.broadcast(inner)).groupBy(at.alias("bucket")).agg(F.count_if(F.col("side") == 0).alias("b"), F.count_if(F.col("side") == 1).alias("c"))
    every = inner.select("constant", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bucket"))
    full = every.join(counts, "bucket", "left").select("constant", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("c", F.lit(0)).alias("c"))
    total = full.agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"))
    empty = F.raise_error(F.lit("baseline and current must not be empty")).cast("double")
    shares = full.crossJoin(F.broadcast(total)).withColumn("pb", F.col("b") / F.nullif(F.col("nb"), F.lit(0)) + EPSILON).withColumn("pc", F.col("c") / F.nullif(F.col("nc"), F.lit(0)) + EPSILON)
    out = shares.agg(F.sum((F.col("pc") - F.col("pb")) * F.log(F.col("pc") / F.col("pb"))).alias("psi"), F.max("nb").alias("nb"), F.max("nc").alias("nc"), F.bool_or("constant").alias("constant"))
    return out.select(
        F.when((F.col("nb") == 0) | (F.col("nc") == 0), empty).when(F.col("constant"), 0.0).otherwise(F.col("psi")).alias("psi"),
        F.col("nb").alias("baseline_size"), F.col("nc").alias("current_size"),
    )


def severity(value: Column) -> Column:
    return F.when(value >= SIGNIFICANT, "significant").when(value >= MODERATE, "moderate").otherwise("none")


def embedding_drift(baseline: DataFrame, current: DataFrame, vector: str = "embedding") -> DataFrame:
    """psi, sizes, severity and drifted of cosines to the baseline's centroid."""
    center = centroid(baseline, vector)
    got = psi(project(baseline, center, vector), project(current, center, vector), "x")
    return got.withColumn("severity", severity(F.col("psi"))).withColumn("drifted", F.col("severity") != "none")


def guarded_drift(baseline: DataFrame, current: DataFrame, least: int = 5, vector: str = "embedding") -> DataFrame:
    """``embedding_drift`` where both sides have ``least`` rows; else psi 0, severity none (a daily run is skipped)."""
    sizes = baseline.agg(F.count(F.lit(1)).alias("b")).crossJoin(current.agg(F.count(F.lit(1)).alias("c"))).first()
    if min(sizes["b"], sizes["c"]) >= max(least, 1):
        return embedding_drift(baseline, current, vector)
    return baseline.sparkSession.createDataFrame([(0.0, sizes["b"], sizes["c"], "none", False)], "psi double, baseline_size long, current_size long, severity string, drifted boolean")


def term_frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    """term, n, freq: shares of all tokens. The total is a sum over the counted terms."""
    counts = texts.select(F.explode(tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("term", "n", (F.col("n") / F.col("total")).alias("freq"))  # total is one row


def term_shift(baseline: DataFrame, current: DataFrame, threshold: float = 0.02, text: str = "text") -> DataFrame:
    """term, base_freq, cur_freq, delta of terms whose share moved by ``threshold`` or more; order by abs(delta) for the report."""
    b = term_frequencies(baseline, text).select("term", F.col("freq").alias("base_freq"))
    c = term_frequencies(current, text).select("term", F.col("freq").alias("cur_freq"))
    rows = b.join(c, "term", "full").select("term", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("base_freq", "cur_freq")])
    return rows.withColumn("delta", F.col("cur_freq") - F.col("base_freq")).where(F.abs("delta") >= threshold)


def top_shifts(shift: DataFrame, n: int = 20) -> DataFrame:
    return shift.orderBy(F.round(F.abs("delta"), 12).desc(), "term").limit(n)


def new_terms(baseline: DataFrame, current: DataFrame, text: str = "text") -> DataFrame:
    """Terms of ``current`` that ``baseline`` lacks (swap the arguments for dropped terms)."""
    one = lambda x: x.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).distinct()
    return one(current).join(one(baseline), "term", "left_anti")


def streaks(daily: DataFrame, eps: float = 0.0, alert: int = 3) -> DataFrame:
    """metric, streak, latest, day, regressing from (metric, day, score): how many days the score has fallen by more than ``eps``, up to the last one.

    Days without a score are passed over.
    """
    rows = daily.where("score is not null").withColumn("before", F.lag("score").over(Window.partitionBy("metric").orderBy("day")))
    rows = rows.withColumn("falls", F.coalesce(F.col("score") < F.col("before") - eps, F.lit(False)))
    stop = F.max(F.when(~F.col("falls"), F.col("day")))
    last = rows.groupBy("metric").agg(stop.alias("stop"), F.max_by("score", "day").alias("latest"), F.max("day").alias("last_day"))
    out = rows.join(last, "metric").groupBy("metric", "latest", "last_day").agg(F.count_if(F.col("day") > F.col("stop")).alias("streak"))
    return out.select("metric", "streak", "latest", F.col("last_day").alias("day"), (F.col("streak") >= alert).alias("regressing"))


def regression_alert(found: DataFrame) -> DataFrame:
    """One row: is_regressing and the alert's text, or null."""
    line = F.concat("metric", F.lit(": "), F.col("streak").cast("string"), F.lit(" consecutive days declining (latest="), F.format_string("%.4f", "latest"), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.when(F.col("regressing"), line)))
    out = found.agg(F.coalesce(F.bool_or("regressing"), F.lit(False)).alias("is_regressing"), F.max("day").alias("day"), rows.alias("lines"))
    text = F.concat(F.lit("Quality regression detected on "), F.col("day").cast("string"), F.lit(": "), F.array_join("lines", "; "))
    return out.select("is_regressing", F.when(F.col("is_regressing"), text).alias("alert"))


def feedback_summary(rows: DataFrame, keys: tuple[str, ...] = (), least: int = 5, rate: float = 0.30) -> DataFrame:
    """total, up, down, down_rate and alert of reactions, for each of ``keys`` if any."""
    up, down = F.count_if(F.col("reaction") == "up"), F.count_if(F.col("reaction") == "down")
    grouped = rows.groupBy(*keys) if keys else rows
    out = grouped.agg(F.count(F.lit(1)).alias("total"), up.alias("up"), down.alias("down"))
    raw = F.coalesce(F.col("down") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return out.withColumn("down_rate", F.round(raw, 4)).withColumn("alert", (F.col("total") >= least) & (raw >= rate))


def worst_queries(rows: DataFrame, n: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """The n queries with most down reactions (for each of ``keys`` if any), ties by identifier; rows without one are left out."""
    counts = rows.where((F.col("reaction") == "down") & F.col("query_id").isNotNull() & (F.col("query_id") != "")).groupBy(*keys, "query_id").agg(F.count(F.lit(1)).alias("down_count"))
    if not keys:
        return counts.orderBy(F.desc("down_count"), "query_id").limit(n)
    order = Window.partitionBy(*keys).orderBy(F.desc("down_count"), "query_id")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def between(rows: DataFrame, ts: str, now: str, first: float, last: float = 0) -> DataFrame:
    """Rows from ``first`` days before ``now`` up to, but without, ``last`` days before it."""
    back = lambda days: F.to_timestamp(F.lit(now)) - F.make_dt_interval(days=F.lit(0), secs=F.lit(float(days) * 86400))
    return rows.where((F.col(ts) >= back(first)) & (F.col(ts) < back(last)))


def drift_windows(rows: DataFrame, ts: str, now: str, days: tuple[float, float, float] = (37, 30, 1)) -> tuple[DataFrame, DataFrame]:
    """The baseline window, from days[0] to days[1] days before ``now``, and the current one, the last days[2] days."""
    return between(rows, ts, now, days[0], days[1]), between(rows, ts, now, days[2])


def trailing(rows: DataFrame, ts: str, now: str, days: float = 7) -> DataFrame:
    """Rows of the last ``days`` days before ``now`` and later ones."""
    return rows.where(F.col(ts) >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(days=F.lit(0), secs=F.lit(float(days) * 86400)))


def regression_run(history: DataFrame, today: DataFrame, n: int, eps: float = 0.0, alert: int = 3) -> DataFrame:
    """Streaks over ``history`` (metric, day, score) and today's means over the first n queries of ``today`` (metric, query_id, day, score).

    A day of the history that is run again is replaced. Append the same means to the stored history, and pass the result to ``regression_alert``.
    """
    asked = today.select("query_id").where("query_id is not null").distinct().orderBy("query_id").limit(n)
    means = today.join(F.broadcast(asked), "query_id").groupBy("metric", "day").agg(F.avg("score").alias("score"))  # n rows
    old = history.join(means.select("metric", "day"), ["metric", "day"], "left_anti")
    return streaks(old.select("metric", "day", "score").unionByName(means), eps, alert)


def drift_alert(drift: DataFrame, shifts: DataFrame, regression: DataFrame) -> DataFrame:
    """One row: whether any of the three monitors asks for attention."""
    moved = shifts.agg(F.count(F.lit(1)).alias("shifted_terms"))
    out = drift.select("drifted").crossJoin(moved).crossJoin(regression.select("is_regressing"))  # one row each
    return out.withColumn("alert", F.col("drifted") | (F.col("shifted_terms") > 0) | F.col("is_regressing"))
