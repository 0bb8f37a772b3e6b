"""Ranking metrics for all queries at once, benchmark rows and their gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.quantiles import quantiles

GATE = 0.50


def _gain(label: Column, exponential: bool) -> Column:
    return F.pow(F.lit(2.0), label.cast("double")) - 1 if exponential else label.cast("double")


def metrics(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (3, 5, 10), k: int = 10, keys: tuple[str, ...] = ("query_id",), doc_id: str = "doc_id") -> DataFrame:
    """For each list: ndcg (linear gain), ndcg_exp (2**gain - 1), mrr and prec_at_<k>.

    ``ranked`` has ``keys`` (the last of them the query), ``doc_id`` and rank; ``qrels`` the query, ``doc_id`` and label, where a missing label is 0.
    Positions are counted from the order of rank, so gaps don't matter. The ideal list has all labels of the query, found or not. Precision divides by
    the length of the list up to k. Values are 0 where nothing is ranked at k or nothing is relevant.
    """
    query = keys[-1]
    place = Window.partitionBy(*keys).orderBy("rank", doc_id)
    rows = ranked.withColumn("pos", F.row_number().over(place)).join(qrels.select(query, doc_id, "label"), [query, doc_id], "left")
    best = Window.partitionBy(query).orderBy(F.desc("label"))
    return _measured(rows, qrels.withColumn("pos", F.row_number().over(best)), ks, k, keys)


def labelled_metrics(rows: DataFrame, counts: DataFrame, ks: tuple[int, ...] = (3, 5, 10), k: int = 10, query: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """``metrics`` of ranked rows that have their label (null is 0); ``counts`` has query, label and n, how many the query has of that label.

    No pair of a query and an unranked document is made: of ``counts``, at most k rows of each label are.
    """
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy("rank", doc_id)))
    few = counts.where("n > 0").select(query, "label", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))).alias("nth"))
    best = Window.partitionBy(query).orderBy(F.desc("label"))
    return _measured(rows, few.withColumn("pos", F.row_number().over(best)), ks, k, (query,))


def _measured(rows: DataFrame, placed: DataFrame, ks: tuple[int, ...], k: int, keys: tuple[str, ...]) -> DataFrame:
    """The measures of ``rows`` (keys, pos, label) against the ideal lists ``placed`` (query, pos, label)."""
    query = keys[-1]
    rows = rows.withColumn("label", F.coalesce("label", F.lit(0)))
    cut = F.col("pos") <= k
    agg = [
        F.sum(F.when(cut, _gain(F.col("label"), e) / F.log2(F.col("pos") + 1.0)).otherwise(0.0)).alias(n) for n, e in (("dcg", False), ("dcg_exp", True))
    ]
    agg.append(F.min(F.when(F.col("label") > 0, F.col("pos"))).alias("first"))
    agg += [(F.sum(F.when((F.col("pos") <= n) & (F.col("label") > 0), 1).otherwise(0)) / F.least(F.lit(n), F.count(F.lit(1)))).alias(f"prec_at_{n}") for n in ks]
    got = rows.groupBy(*keys).agg(*agg)
    ideal = placed.where(F.col("pos") <= k).groupBy(query).agg(
        *[F.sum(_gain(F.col("label"), e) / F.log2(F.col("pos") + 1.0)).alias(n) for n, e in (("idcg", False), ("idcg_exp", True))]
    )
    out = got.join(ideal, query, "left")
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), F.lit(0.0))
    return out.select(
        *keys, share("dcg", "idcg").alias("ndcg"), share("dcg_exp", "idcg_exp").alias("ndcg_exp"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), *[F.col(f"prec_at_{n}").cast("double") for n in ks],
    )


def benchmark_rows(ranked: DataFrame, qrels: DataFrame, cost_per_query: dict[str, float] | None = None, doc_id: str = "doc_id") -> DataFrame:
    """One row for each config and query that has a pool: metrics at 10 and the query's cost."""
    rows = metrics(ranked, qrels, keys=("config", "query_id"), doc_id=doc_id).drop("ndcg_exp").withColumnRenamed("ndcg", "ndcg_at_10")
    cost = F.lit(0.0)
    for config, price in (cost_per_query or {}).items():
        cost = F.when(F.col("config") == config, F.lit(float(price))).otherwise(cost)
    return rows.withColumn("cost_usd", cost)


MEANS = ("ndcg_at_10", "mrr", "prec_at_3", "prec_at_5", "prec_at_10")


def aggregate(rows: DataFrame) -> DataFrame:
    """Means of the metrics by config (and of latency_ms, if there is one), the sum of cost, the number of queries."""
    means = [c for c in (*MEANS, "latency_ms") if c in rows.columns]
    return rows.groupBy("config").agg(*[F.avg(c).alias(c) for c in means], F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("num_queries"))


def gate(results: DataFrame, threshold: float = GATE, metric: str = "ndcg_at_10") -> DataFrame:
    """One row: passed, and the failed configs in order. An empty input is an error when the row is read."""
    failed = F.array_sort(F.collect_list(F.when(F.col(metric) < threshold, F.col("config"))))
    out = results.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col(metric) >= threshold).alias("passed"), F.array_join(failed, ",").alias("failed"))
    return out.select(F.when(F.col("n") == 0, F.raise_error(F.lit("no results to gate"))).otherwise(F.col("passed")).cast("boolean").alias("passed"), "failed")


def spread(rows: DataFrame, metric: str = "ndcg_at_10") -> DataFrame:
    """Quartiles and mean of a metric by config."""
    rows = rows.select("config", metric)
    quarters = [F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    return quantiles(rows, metric, [0.25, 0.5, 0.75], ("config",)).select("config", *quarters).join(rows.groupBy("config").agg(F.avg(metric).alias("mean")), "config")


def winner(means: DataFrame, name: str = "config", metric: str = "ndcg_at_10", expected: int | None = None) -> DataFrame:
    """The name with the largest metric, the first by name on a tie; null unless ``expected`` results are in."""
    best = F.min_by(name, F.struct((-F.round(metric, 9)).alias("m"), F.col(name).alias("n")))
    out = means.agg(best.alias("winner"), F.count(F.lit(1)).alias("n"))
    return out.select((F.when(F.col("n") >= expected, F.col("winner")) if expected else F.col("winner")).alias("winner"))
