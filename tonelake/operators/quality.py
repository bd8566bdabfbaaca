"""Data-quality operators: issue logs, check rows, assertions, comparisons with tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def check_rows(df: DataFrame, group: str, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """(group, check, severity, failures, passed): `checks` maps a name to (severity, condition of a bad row). One aggregate, then unpivoted."""
    got = df.groupBy(group).agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, (_, bad) in checks.items()))
    cells = F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(n).alias("failures")) for n, (s, _) in checks.items())))
    return got.select(group, cells).withColumn("passed", F.col("failures") == 0)


def repeated_vectors(df: DataFrame, group: str, key: str, vector: str, digits: int = 8) -> DataFrame:
    """(group, key, previous): rows whose rounded vector another row of the group has, paired with the previous holder by key."""
    v = F.transform(vector, lambda x: F.round(x, digits))
    h = df.select(group, key, F.sha2(F.array_join(F.transform(v, lambda x: x.cast("string")), ","), 256).alias("_h"))
    return h.withColumn("previous", F.lag(key).over(W.partitionBy(group, "_h").orderBy(key))).where("previous is not null").select(group, key, "previous")


def issues(df: DataFrame, key: list[str], rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(*key, code, field): one row per rule that holds; `rules` maps a code to (field, condition). One pass."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))) for code, (field, c) in rules.items())))
    return df.select(*key, F.inline(found))


def ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: (key, value_count)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("value_count")).where("value_count > 1")


def population_gaps(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, gap): expected keys not observed, and observed ones not expected."""
    a, b = observed.select(*keys).distinct(), expected.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("gap", F.lit("not_observed")).unionByName(a.join(b, keys, "left_anti").withColumn("gap", F.lit("not_expected")))


def compare(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(column, compared, beyond, greatest_abs_error, greatest_rel_error) over the common keys; equal where |a - b| <= atol + rtol |b|."""
    both = left.select(*keys, *(F.col(c).alias(f"l_{c}") for c in columns)).join(right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in columns)), keys)
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").cast("double").alias("a"), F.col(f"r_{c}").cast("double").alias("b")) for c in columns)))
    e = F.abs(F.col("a") - F.col("b"))
    return both.select(cells).where("a is not null and b is not null").groupBy("column").agg(F.count(F.lit(1)).alias("compared"), F.count_if(e > atol + rtol * F.abs(F.col("b"))).alias("beyond"), F.max(e).alias("greatest_abs_error"), F.max(e / F.greatest(F.abs(F.col("b")), F.lit(1e-12))).alias("greatest_rel_error"))


def require_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`left` joined with `right`, raising ValueError if a key repeats on either side or lacks a partner."""
    for name, df in (("left", left), ("right", right)):
        n = df.agg(F.count(key).alias("n"), F.count_distinct(key).alias("k")).first()
        if n["n"] != n["k"]:
            raise ValueError(f"{name} side: {n['n'] - n['k']} repeated keys")
    if left.join(right, key, "left_anti").limit(1).count():
        raise ValueError("keys of the left side without a partner")
    return left.join(right, key)
