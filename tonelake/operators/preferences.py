"""Preferences with ties, pivots, histograms, correlations, bins, changes over steps, and summaries of draws."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions.numeric import is_finite
from tonelake.operators import ranking
from tonelake.operators.ratings import average_rank


def winners(df: DataFrame, trial: list[str], item: str, score: str) -> DataFrame:
    """Per trial: best score, its items (sorted, joined), how many, and whether they tie. Rows without a score do not compete.

    One aggregate: items are collected per (trial, score) and the best entry is kept, so nothing is joined back.
    """
    per_score = df.where(F.col(score).isNotNull()).groupBy(*trial, score).agg(F.array_sort(F.collect_set(item)).alias("_items"), F.count(F.lit(1)).alias("_rows"))
    best = per_score.groupBy(*trial).agg(F.max(F.struct(score, "_items")).alias("b"), F.sum("_rows").alias("scored"))
    return best.select(*trial, F.col(f"b.{score}").alias("best"), F.array_join("b._items", "|").alias("winners"), F.size("b._items").alias("winner_count"), (F.size("b._items") > 1).alias("tie"), "scored")


def joint_winners(w: DataFrame, trial: list[str]) -> DataFrame:
    """Tied trials in long form: (*trial, winner)."""
    return w.where("tie").select(*trial, F.explode(F.split("winners", r"\|")).alias("winner"))


def derived_preference(w: DataFrame, trial: list[str]) -> DataFrame:
    """(*trial, preferred, tied): the single winner, or null and the tied items."""
    return w.select(*trial, F.when(~F.col("tie"), F.col("winners")).alias("preferred"), F.when(F.col("tie"), F.col("winners")).otherwise("").alias("tied"))


def pivot_counts(df: DataFrame, rows: str, columns: str, levels: list[str]) -> DataFrame:
    out = df.groupBy(rows).pivot(columns, levels).agg(F.count(F.lit(1)))
    return out.na.fill(0, levels)


def pivot_means(df: DataFrame, rows: str, columns: str, levels: list[str], value: str) -> DataFrame:
    return df.groupBy(rows).pivot(columns, levels).agg(F.avg(value))


def level_grid(df: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Count, mean, sd, least and greatest for every combination of levels; unobserved ones have count 0."""
    seen = df.groupBy(first, second).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    a, b = seen.select(first).distinct(), seen.select(second).distinct()  # the levels, not the rows
    return a.join(b).join(seen, [first, second], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, rows): bin 0 is below `low`, bins + 1 from `high` on."""
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def pearson_pairs(df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """(group, x, y, r, n) of each pair of columns, in one aggregate over rows where both are present; null for a constant column."""
    names = list(combinations(columns, 2))
    cells = F.inline(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v")) for a, b in names)))
    by = [group] if group else []
    long = df.select(*by, cells).where("u is not null and v is not null and not isnan(u) and not isnan(v)")
    r = F.when((F.stddev_pop("u") > 1e-12) & (F.stddev_pop("v") > 1e-12), F.corr("u", "v"))
    return long.groupBy(*by, "x", "y").agg(r.alias("r"), F.count(F.lit(1)).alias("n"))


def spearman_pairs(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Correlations of average ranks within each group; rows with any missing column are left out."""
    whole = df.select(group, *(F.col(c).cast("double").alias(c) for c in columns)).where(reduce(lambda x, y: x & y, (is_finite(F.col(c)) for c in columns)))
    return pearson_pairs(whole.select(group, *(average_rank(c, group).alias(c) for c in columns)), columns, group)


def quantile_bins(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Adds `bin` (1..): right-closed bins between the column's exact percentiles, the lowest value included. Percentiles come from distributed row numbers."""
    q = ranking.exact_quantiles(df.select(F.lit(1).alias("_one"), value), "_one", value, shares)
    edges = q.agg(F.collect_list("quantile").alias("_edges"))  # one row of a few numbers
    out = df.join(F.broadcast(edges))
    above = F.size(F.filter("_edges", lambda e: F.col(value) > e))
    return out.withColumn("bin", F.when(F.col(value).isNotNull(), above + 1)).drop("_edges")


def changes(df: DataFrame, step: str, metrics: list[str], group: list[str] | None = None) -> DataFrame:
    """Adds `<metric>_change`, the first difference along `step`. For aggregated tables."""
    w = W.partitionBy(*(group or [])).orderBy(step)
    return df.select("*", *((F.col(m) - F.lag(m).over(w)).alias(f"{m}_change") for m in metrics))


def adequate(df: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds `passes`: every metric is within its limit; `limits` maps a metric to (`<=` or `>=`, limit). A missing metric fails."""
    ok = F.lit(True)
    for m, (op, limit) in limits.items():
        ok &= F.coalesce(F.col(m) <= limit if op == "<=" else F.col(m) >= limit, F.lit(False))
    return df.withColumn("passes", ok)


def least_passing(df: DataFrame, scenario: str, size: str) -> DataFrame:
    """Per scenario the least size that passes, and the least size that passes in all scenarios (null if none)."""
    own = df.groupBy(scenario).agg(F.min(F.when(F.col("passes"), F.col(size))).alias("least_size"))
    every = df.groupBy(size).agg(F.bool_and("passes").alias("all"), F.count_distinct(scenario).alias("k")).join(df.agg(F.count_distinct(scenario).alias("of"))).where(F.col("all") & (F.col("k") == F.col("of"))).agg(F.min(size).alias("recommended"))
    return own.join(F.broadcast(every))


def winner_probability(draws: DataFrame, group: str, draw: str, item: str, value: str) -> DataFrame:
    """(group, item, probability, tie_probability): the share of draws an item wins, ties shared equally."""
    w = W.partitionBy(group, draw)
    top = draws.withColumn("_best", F.max(value).over(w)).withColumn("_won", (F.col(value) == F.col("_best")).cast("int"))
    top = top.withColumn("_k", F.sum("_won").over(w))
    return top.groupBy(group, item).agg(F.avg(F.col("_won") / F.col("_k")).alias("probability"), F.avg(F.when((F.col("_won") == 1) & (F.col("_k") > 1), 1.0).otherwise(0.0)).alias("tie_probability"))


def narrowest_interval(df: DataFrame, group: str, value: str, share: float = 0.94) -> DataFrame:
    """(group, n, low, high): the narrowest window that holds floor(share n) + 1 of the sorted values; ties to the lowest."""
    numbered = ranking.numbered(df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("_v")), group, ["_v"])
    low = numbered.select(group, F.col("rows").alias("_n"), F.floor(F.lit(share) * F.col("rows")).cast("int").alias("_k"), F.col("row").alias("_i"), F.col("_v").alias("low"))
    high = numbered.select(F.col(group).alias("_g"), F.col("row").alias("_j"), F.col("_v").alias("high"))
    pairs = low.join(high, (F.col(group) == F.col("_g")) & (F.col("_j") == F.col("_i") + F.col("_k")))
    return pairs.groupBy(group).agg(F.max("_n").alias("n"), F.min(F.struct((F.round(F.col("high") - F.col("low"), 12)).alias("w"), "low", "high")).alias("b")).select(group, "n", "b.low", "b.high")


def tail_interval(df: DataFrame, group: str, value: str, share: float = 0.94) -> DataFrame:
    """(group, mean, low, high): the equal-tailed interval."""
    q = F.percentile(value, F.array(F.lit((1 - share) / 2), F.lit((1 + share) / 2)))
    return df.groupBy(group).agg(F.avg(value).alias("mean"), q.alias("q")).select(group, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def recovery(df: DataFrame, group: str, estimate: Column, truth: Column, low: Column, high: Column) -> DataFrame:
    """Bias, absolute and squared error, interval coverage, width and sign agreement per group."""
    e = estimate - truth
    return df.groupBy(group).agg(F.count(e).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(truth.between(low, high).cast("double")).alias("covered"), F.avg(high - low).alias("width"), F.avg((F.signum(estimate) == F.signum(truth)).cast("double")).alias("sign"))


def variance_ratio(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: variance between group means, mean variance within groups, and the share between."""
    per = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    got = per.agg(F.var_samp("m").alias("between_var"), F.avg("v").alias("within_var"))
    return got.withColumn("ratio", F.col("between_var") / (F.col("between_var") + F.col("within_var")))
