"""Row numbers within groups of any size, without a window over a group.

Rows are range-partitioned by group and order, so a hot group spreads over many tasks; each partition numbers its rows,
and the few (group, partition) counts tell where a group's numbers go on. The numbered rows are written to the shared
checkpoint folder, since range boundaries are drawn by sampling and must not be drawn twice.

Defined results: rows with a null group are left out; ties are numbered in any but a fixed order, so `order` should be
total where that matters; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.sources.tables import cut, join_small


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `row` (from 1) and `rows` of each row's group, in ascending order."""
    # equal rows are told apart by a random number, so that even they spread over partitions
    spread = df.where(F.col(group).isNotNull()).withColumn("_u", F.rand(7)).repartitionByRange(group, *order, "_u")
    placed = cut(spread.drop("_u").sortWithinPartitions(group, *order).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_m", 33))
    parts = placed.groupBy(group, "_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_c"))
    # one row per group and partition that it touches
    g = W.partitionBy(group)
    offsets = parts.select(group, "_p", "_first", (F.sum("_c").over(g.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(g).alias("rows"))
    return join_small(placed, offsets, [group, "_p"], "_m").withColumn("row", F.col("_m") - F.col("_first") + F.col("_before") + 1).drop("_m", "_p", "_first", "_before")


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, share, quantile): linear quantiles of each group, from the two rows that surround each."""
    x = numbered(df.where(F.col(value).isNotNull()).select(group, value), group, [value])
    at = F.inline(F.array(*(F.struct(F.lit(s).alias("share"), ((F.col("rows") - 1) * F.lit(s) + 1).alias("at")) for s in shares)))
    near = x.select("*", at).where((F.col("row") >= F.floor("at")) & (F.col("row") <= F.ceil("at")))
    return near.groupBy(group, "share").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max(F.col("at") - F.floor("at")).alias("w")).select(group, "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("quantile"))
