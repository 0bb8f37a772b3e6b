"""Agreement of two orderings of the same pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.quantiles import quantiles


def both_ranks(a: DataFrame, c: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """query_id, doc_id, rank_a, rank_c; pools that differ are an error when the rows are read."""
    rows = a.select(query_id, doc_id, F.col("rank").alias("rank_a")).join(c.select(query_id, doc_id, F.col("rank").alias("rank_c")), [query_id, doc_id], "full")
    lost = F.col("rank_a").isNull() | F.col("rank_c").isNull()
    return rows.withColumn("rank_a", F.when(lost, F.raise_error(F.lit("the orderings differ in their items")).cast("long")).otherwise(F.col("rank_a")))


def spearman_full(ranks: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Ranks are permutations, so Pearson's correlation of them is Spearman's; null below two items."""
    return ranks.groupBy(query_id).agg(F.corr(F.col("rank_a").cast("double"), F.col("rank_c").cast("double")).alias("rho"))


def spearman_head(ranks: DataFrame, n: int = 10, query_id: str = "query_id") -> DataFrame:
    """Over items in the first n of either ordering, ranked anew among themselves; null below two items."""
    head = ranks.where((F.col("rank_a") <= n) | (F.col("rank_c") <= n))
    for c in ("rank_a", "rank_c"):
        head = head.withColumn(c, F.row_number().over(Window.partitionBy(query_id).orderBy(c)))
    return spearman_full(head, query_id)


def overlaps(ranks: DataFrame, query_id: str = "query_id") -> DataFrame:
    """overlap_at_10, overlap_at_5 and top1_match."""
    in_both = {n: F.count_if((F.col("rank_a") <= n) & (F.col("rank_c") <= n)) for n in (1, 5, 10)}
    return ranks.groupBy(query_id).agg(in_both[10].alias("overlap_at_10"), in_both[5].alias("overlap_at_5"), (in_both[1] == 1).alias("top1_match"))


def rbo(ranks: DataFrame, p: float = 0.9, query_id: str = "query_id") -> DataFrame:
    """Rank-biased overlap, extrapolated at the pool's depth.

    An item is in both prefixes from depth max(rank_a, rank_c) on, so the overlap at each depth is a running count.
    """
    both = ranks.groupBy(query_id, F.greatest("rank_a", "rank_c").alias("d")).agg(F.count(F.lit(1)).alias("met"))
    depth = ranks.groupBy(query_id).agg(F.count(F.lit(1)).alias("k")).withColumn("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    met = F.sum(F.coalesce("met", F.lit(0))).over(Window.partitionBy(query_id).orderBy("d"))
    rows = depth.join(both.withColumn("d", F.col("d").cast("long")), [query_id, "d"], "left").withColumn("x", met)
    weight = F.pow(F.lit(p), F.col("d"))
    total = F.sum(F.col("x") / F.col("d") * weight) * ((1 - p) / p)
    last = F.max(F.when(F.col("d") == F.col("k"), F.col("x") / F.col("k") * weight))
    return rows.groupBy(query_id).agg((last + total).alias("rbo"))


def by_case(rows: DataFrame, case: str, columns: list[str]) -> DataFrame:
    """Means by case."""
    return rows.groupBy(case).agg(*[F.avg(c).alias(c) for c in columns])


def summary(rows: DataFrame, column: str) -> DataFrame:
    """Mean, median, least and greatest of one statistic over all queries."""
    middle = quantiles(rows, column, [0.5]).select(F.get("q", F.lit(0)).alias("median"))
    whole = rows.agg(F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("greatest"))
    return whole.crossJoin(middle).select("mean", "median", "least", "greatest")  # one row each


def gap(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: in how many rows ``a`` is above ``b``, of how many in which both are known, and the mean of a - b."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.agg(F.count_if(F.col(a) > F.col(b)).alias("n_above"), F.count(F.lit(1)).alias("n"), F.avg(F.col(a) - F.col(b)).alias("mean_gap"))
