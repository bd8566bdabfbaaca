"""Joined inventories: join status, validity with reasons, duplicates, roll-ups and mappings.

Dimensions are joined without hints: adaptive execution broadcasts what proves small at run time and splits hot keys of
what does not. Roll-ups are single aggregates with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_status(facts: DataFrame, dimensions: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """`facts` with the columns of each dimension and `join_status`: matched, or missing_ and the names of those without a partner.

    `dimensions` maps a name to (rows, key of the facts, key of the rows); the rows' keys must be distinct. Null keys have no partner.
    """
    out, missing = facts, []
    for name, (rows, fact_key, key) in dimensions.items():
        out = out.join(rows.withColumn(f"_has_{name}", F.lit(True)).withColumnRenamed(key, f"_{name}_key"), F.col(fact_key) == F.col(f"_{name}_key"), "left")
        missing.append(F.when(F.col(f"_has_{name}").isNull(), F.lit(name)))
    lacking = F.array_compact(F.array(*missing))
    status = F.when(F.size(lacking) == 0, "matched").otherwise(F.concat(F.lit("missing_"), F.array_join(lacking, "_and_")))
    return out.withColumn("join_status", status).drop(*(f"_has_{n}" for n in dimensions), *(f"_{n}_key" for n in dimensions))


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `reasons` (the codes of all rules that hold, in order, joined by `;`) and `valid`. A null condition does not hold."""
    codes = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules.items())))
    return df.withColumn("reasons", F.array_join(codes, ";")).withColumn("valid", F.size(codes) == 0)


def with_first_reason(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `reason`: the code of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for code, c in reversed(rules.items()):
        out = F.when(F.coalesce(c, F.lit(False)), F.lit(code)).otherwise(out)
    return df.withColumn("reason", out)


def with_copies(df: DataFrame, key: str) -> DataFrame:
    """Adds `copies`, the rows with the same non-blank key, and `is_duplicate`. Counted first, then joined, so a hot key is never one window."""
    counts = df.where(F.col(key).isNotNull() & (F.trim(F.col(key)) != "")).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("copies"))
    return df.join(counts, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("copies", F.coalesce("copies", F.lit(0).cast("bigint"))).withColumn("is_duplicate", F.col("copies") > 1)


def rollup(df: DataFrame, by: str, flag: Column, code: str, measure: str) -> DataFrame:
    """Per group: rows, flagged rows, distinct codes as a sorted list, least, greatest and range of the measure."""
    codes = F.array_sort(F.collect_set(F.when(F.trim(F.col(code)) != "", F.col(code))))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("flagged"), F.size(codes).alias("code_count"), F.array_join(codes, "|").alias("codes"),
        F.min(measure).alias("least"), F.max(measure).alias("greatest"), (F.max(measure) - F.min(measure)).alias("span"),
    )


def ranked_where(df: DataFrame, ok: Column, order: list[Column]) -> DataFrame:
    """Adds `rank` among the rows where `ok` holds, in `order` (which must be total); null elsewhere. For aggregated tables: one window over all rows."""
    return df.withColumn("rank", F.when(ok, F.sum(ok.cast("int")).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))))


def last_wins(df: DataFrame, keys: list[str], values: list[str], sequence: str) -> DataFrame:
    """One row per key with the values of the row of highest sequence."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(sequence)).alias("_v"), F.max(sequence).alias(sequence)).select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values), sequence)


def table_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed rows by a hash of all other columns."""
    columns = sorted(c for c in before.columns if c != key)
    h = lambda df, name: df.select(F.col(key), F.sha2(F.to_json(F.struct(*columns)), 256).alias(name))
    both = h(before, "h1").join(h(after, "h2"), key, "full_outer")
    return both.select(key, F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").when(F.col("h1") != F.col("h2"), "changed").alias("change")).where("change is not null")
