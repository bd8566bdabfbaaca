"""Rating aggregation: full descriptive statistics, coverage, context, warnings and within-group descriptors.

One aggregate per summary: exact quartiles come from a single array percentile, whose state is a map of distinct values
(scores on a scale have few), and small distinct counts from collected sets. Within-group descriptors are windows over
summaries, never over the ratings themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions.numeric import finite, is_finite
from tonelake.functions.stats import standard_error, t975


def _names(c: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.trim(F.col(c)) != "", F.col(c))))


def rating_summary(df: DataFrame, item: str, score: str, raters: str, institutions: str, low_count: int = 5) -> DataFrame:
    """Per item: counts, distinct raters and institutions, mean, quartiles, spread, t interval and status.

    Missing scores (null, NaN, infinite) count as missing; distinct counts include rows without a score; spread and interval are null below two scores.
    """
    x = finite(F.col(score).cast("double"))
    got = df.groupBy(item).agg(
        F.count(x).alias("n"), F.count_if(~is_finite(F.col(score).cast("double"))).alias("missing"), F.size(F.collect_set(raters)).alias("raters"), F.size(_names(institutions)).alias("institution_count"), F.array_join(_names(institutions), "|").alias("institutions"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.var_samp(x).alias("variance"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min(x).alias("least"), F.max(x).alias("greatest"),
    )
    n = F.col("n")
    se = standard_error(F.col("sd"), n)
    half = t975(n - 1) * se
    many = lambda c: F.when(n > 1, c)
    return got.select(
        item, "n", "missing", "raters", "institution_count", "institutions", "mean", F.col("q")[1].alias("median"), many(F.col("sd")).alias("sd"), many(F.col("variance")).alias("variance"), se.alias("se"),
        F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "least", "greatest", (F.col("greatest") - F.col("least")).alias("span"),
        many(F.col("mean") - half).alias("ci_low"), many(F.col("mean") + half).alias("ci_high"), F.when(n > 1, "student_t").otherwise("unavailable").alias("ci_method"),
        ((n > 0) & (n < low_count)).alias("low_count"), F.when(n == 0, "unrated").when(n < low_count, "low_count").otherwise("ok").alias("status"),
    )


def keep_unrated(items: DataFrame, item: str, summary: DataFrame) -> DataFrame:
    """All distinct items with their summary; items without any rating row are `unrated` with n = 0."""
    return items.select(item).where(F.col(item).isNotNull()).distinct().join(summary, item, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))).withColumn("status", F.coalesce("status", F.lit("unrated")))


def average_rank(x: str, group: str) -> Column:
    """Rank within the group, ties sharing their mean."""
    return F.rank().over(W.partitionBy(group).orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(group, x)) - 1) / F.lit(2.0)


def within_group(df: DataFrame, group: str, x: str, se: str, n: str) -> DataFrame:
    """Adds rank, pct, centred, z, robust_z and weight of `x` within its group. Rows without `x` must be filtered before."""
    g = W.partitionBy(group)
    out = df.withColumn("rank", average_rank(x, group)).withColumn("_of", F.count(F.lit(1)).over(g))
    out = out.withColumn("pct", F.col("rank") / F.col("_of")).withColumn("centred", F.col(x) - F.avg(x).over(g)).withColumn("_sd", F.stddev_samp(x).over(g)).withColumn("_med", F.percentile(x, F.lit(0.5)).over(g))
    out = out.withColumn("z", F.when(F.col("_sd") > 0, F.col("centred") / F.col("_sd"))).withColumn("_dev", F.abs(F.col(x) - F.col("_med")))
    out = out.withColumn("_mad", F.percentile("_dev", F.lit(0.5)).over(g)).withColumn("robust_z", F.when(F.col("_mad") > 0, (F.col(x) - F.col("_med")) / (F.lit(1.4826) * F.col("_mad"))))
    raw = F.when(F.col(se) > 0, 1 / F.col(se)).otherwise(F.col(n) / F.max(n).over(g))
    out = out.withColumn("_raw", raw)
    return out.withColumn("weight", F.when(F.max("_raw").over(g) > 0, F.col("_raw") / F.max("_raw").over(g))).drop("_of", "_sd", "_med", "_dev", "_mad", "_raw")


def coverage(summary: DataFrame, group: str, low_count: int = 5) -> DataFrame:
    """Per group of items: items, rated items, ratings, least, median and greatest count, items below the threshold."""
    return summary.groupBy(group).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("n") > 0).alias("rated"), F.sum("n").alias("ratings"), F.min("n").alias("least_count"), F.percentile("n", F.lit(0.5)).alias("median_count"), F.max("n").alias("greatest_count"), F.count_if(F.col("n") < low_count).alias("below")
    )


def context_summary(df: DataFrame, contexts: dict[str, Column], score: str) -> DataFrame:
    """Count and mean per value of each context, stacked in one pass: (context, value, rows, scores, mean)."""
    x = finite(F.col(score).cast("double"))
    cells = F.inline(F.array(*(F.struct(F.lit(name).alias("context"), c.cast("string").alias("value")) for name, c in contexts.items())))
    return df.select(x.alias("_x"), cells).groupBy("context", "value").agg(F.count(F.lit(1)).alias("rows"), F.count("_x").alias("scores"), F.avg("_x").alias("mean"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, present, absent, distinct_values, least, greatest) of each column as text; distinct values count null as one."""
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    counts = df.select(cells).groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("k"))), F.lit(0).cast("bigint")).alias("present"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0).cast("bigint")).alias("absent"),
        F.count(F.lit(1)).alias("distinct_values"), F.min("value").alias("least"), F.max("value").alias("greatest"),
    )


def feature_summary(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """(group, feature, n, mean, sd, least, q25, median, q75, greatest, iqr, cov) of the finite values."""
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), finite(F.col(c).cast("double")).alias("x")) for c in features)))
    return _described(df.select(group, cells), group, "feature")


def band_summary(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, band, n, mean, ...) of an array column by position."""
    return _described(df.select(group, F.posexplode(vector).alias("band", "x")).withColumn("x", finite(F.col("x").cast("double"))), group, "band")


def _described(long: DataFrame, group: str, part: str) -> DataFrame:
    got = long.where("x is not null").groupBy(group, part).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), F.min("x").alias("least"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("x").alias("greatest"))
    return got.select(group, part, "n", "mean", "sd", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "greatest", (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.when(F.abs(F.col("mean")) > 1e-12, F.col("sd") / F.abs(F.col("mean"))).alias("cov"))
