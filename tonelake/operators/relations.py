"""Smaller relational operators: latest rows, disjunctive matches, set overlaps, inclusion, contributions, predictors, mixdowns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the last by `order`. Null keys are dropped."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *(k for k in keep if k not in order))).alias("_l")).select(key, *(F.col(f"_l.{k}").alias(k) for k in keep))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; null where either is missing or the end lies before."""
    a, b = (F.unix_millis(c.cast("timestamp")) for c in (start, end))
    return F.when(b >= a, b - a)


def match_any(rows: DataFrame, known: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """Adds `matched` and `matched_by`: the value of the first of several keys that finds a partner. `known` may repeat keys; its least value counts."""
    found, by = [], []
    for i, (own, theirs) in enumerate(keys):
        one = known.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        rows = rows.join(one, F.col(own) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
        by.append(F.when(F.col(f"_v{i}").isNotNull(), F.lit(own)))
    return rows.withColumn("matched", F.coalesce(*found)).withColumn("matched_by", F.coalesce(*by)).drop(*(f"_{x}{i}" for x in "kv" for i in range(len(keys))))


def set_overlap(a: Column, b: Column) -> dict[str, Column]:
    """Shared members (sorted, joined), their number, the union's size and the share of `a` that is shared."""
    shared = F.array_sort(F.array_intersect(a, b))
    return {"shared": F.array_join(shared, "|"), "overlap": F.size(shared), "union_size": F.size(F.array_union(a, b)), "stability": F.when(F.size(a) > 0, F.size(shared) / F.size(a))}


def inclusion(long: DataFrame, group: str, member: str, method: str) -> DataFrame:
    """(group, member, methods, share): in how many of the group's methods a member is chosen."""
    of = long.groupBy(group).agg(F.count_distinct(method).alias("of"))
    return long.groupBy(group, member).agg(F.count_distinct(method).alias("methods")).join(of, group).select(group, member, "methods", (F.col("methods") / F.col("of")).alias("share"))


def linear_predictor(df: DataFrame, key: str, weights: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """(key, eta): intercept plus the weighted sum of columns; null where a column is missing."""
    eta = F.lit(float(intercept))
    for c, w in weights.items():
        eta = eta + F.lit(float(w)) * F.col(c)
    return df.select(key, eta.alias("eta"))


def band_contrast(vector: Column, low: tuple[int, int], high: tuple[int, int]) -> Column:
    """Mean over one stretch of an array (from, length; 1-based) less the mean over another."""
    mean = lambda s: F.aggregate(F.slice(vector, *s), F.lit(0.0), lambda t, v: t + v) / s[1]
    return mean(high) - mean(low)


def mixdown(df: DataFrame, group: str, samples: str) -> DataFrame:
    """(group, pos, level): arrays of any lengths added up by position."""
    return df.select(group, F.posexplode(samples).alias("pos", "v")).groupBy(group, "pos").agg(F.sum("v").alias("level"))


def top_contributions(scaled: DataFrame, names: list[str], k: int = 2) -> DataFrame:
    """(grp, member, contributions): the `k` coordinates of greatest magnitude as `name+` or `name-`, ties in coordinate order."""
    label = F.array(*(F.lit(n) for n in names))
    parts = F.transform("x", lambda v, i: F.struct((-F.round(F.abs(v), 9)).alias("m"), i.alias("i"), F.concat(F.element_at(label, i.cast("int") + 1), F.when(v < 0, "-").otherwise("+")).alias("t")))
    return scaled.select("grp", "member", F.array_join(F.transform(F.slice(F.array_sort(parts), 1, k), lambda s: s["t"]), ", ").alias("contributions"))


def closest_values(df: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """(group, first, second, gap): the two members nearest in value, ties to the lower values. Sorted neighbours suffice."""
    w = W.partitionBy(group).orderBy(value, member)
    gaps = df.where(F.col(value).isNotNull()).select(group, F.lag(member).over(w).alias("first"), F.col(member).alias("second"), F.round(F.col(value) - F.lag(value).over(w), 12).alias("gap"), F.col(value).alias("_v"))
    return gaps.where("gap is not null").groupBy(group).agg(F.min(F.struct("gap", "_v", "first", "second")).alias("b")).select(group, "b.first", "b.second", "b.gap")


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, vif): diagonal of the inverse correlation matrix of rows without missing values. One aggregate row of k(k-1)/2 numbers reaches the driver."""
    whole = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).where(" and ".join(f"{c} is not null and not isnan({c})" for c in columns))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    row = whole.agg(*(F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in pairs)).first()
    m = np.eye(len(columns))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"r{i}_{j}"] if row[f"r{i}_{j}"] is not None else 0.0
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, np.diag(np.linalg.pinv(m)))], "column string, vif double")
