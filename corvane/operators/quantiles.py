"""Exact quantiles that no task needs a whole group for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.store import stored


def quantiles(rows: DataFrame, value: str, probs: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and q: for each group the quantiles of ``value`` (doubles, in the order of ``probs``), interpolated between neighbours.

    Values are range-partitioned and sorted, so a row's rank in its group is its place in its partition and the sizes of the parts before it: a few numbers for
    each partition and group. Only the rows at the wanted ranks are read again. Nulls are left out. Without ``keys`` there is one row; its q is empty if there are no values.
    """
    ordered = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v")
    placed = stored(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered")  # ascending over all rows; a partition's begin at a multiple of 2**33
    parts = placed.groupBy(*keys, F.shiftright("_id", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    group = Window.partitionBy(*keys)  # as many rows as partitions hold the group
    parts = parts.withColumn("_before", F.sum("_n").over(group.orderBy("_p")) - F.col("_n")).withColumn("_all", F.sum("_n").over(group))
    asked = parts.select("*", F.posexplode(F.array(*map(F.lit, map(float, probs)))).alias("_i", "_prob")).withColumn("_at", F.col("_prob") * (F.col("_all") - 1))
    ends = F.array(F.floor("_at"), F.ceil("_at"))
    asked = asked.select(*keys, "_i", "_before", "_n", "_first", F.posexplode(ends).alias("_side", "_rank"), (F.col("_at") - F.floor("_at")).alias("_part"))
    asked = asked.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    wanted = asked.select("_i", "_side", "_part", (F.col("_first") + F.col("_rank") - F.col("_before")).alias("_id"))
    share = F.when(F.col("_side") == 0, 1 - F.col("_part")).otherwise(F.col("_part"))
    each = placed.join(wanted, "_id").groupBy(*keys, "_i").agg(F.sum(F.col("_v") * share).alias("_q"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("q")
    return each.groupBy(*keys).agg(listed) if keys else each.agg(listed)
