"""Further summaries of ratings and simulations, and check tables.

Every summary is one aggregate (or an aggregate of an aggregate); distinct lists are of contexts such as years or
institutions, which are few. Check tables are rows (check, passed, observed, expected).

Defined results: nulls count where a count of nulls is asked and are left out elsewhere; spreads are null below two
values; a constant column is near constant; empty tables give a check row with observed 0 or null; groups that are null
stay groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions.numeric import finite


def context_counts(df: DataFrame, item: str, counts: dict[str, str], lists: dict[str, str]) -> DataFrame:
    """Per item the distinct values of some columns, counted (`counts`) or listed in order, joined by `|` (`lists`). Counted over distinct pairs first, so no set of raters is gathered."""
    out = df.groupBy(item).agg(F.count(F.lit(1)).alias("rows"))
    for name, c in counts.items():
        one = df.where(F.col(c).isNotNull()).select(item, c).distinct().groupBy(F.col(item).alias("_k")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(one, F.col(item).eqNullSafe(F.col("_k")), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    for name, c in lists.items():
        one = df.where(F.col(c).isNotNull()).select(item, c).distinct().groupBy(F.col(item).alias("_k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda v: v.cast("string")), "|").alias(name))
        out = out.join(one, F.col(item).eqNullSafe(F.col("_k")), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def pool_coverage(summary: DataFrame, pool: DataFrame, group: str, item: str, low_count: int = 5) -> DataFrame:
    """Coverage per group of all items and of those in the pool (item): items, rated, least, median and greatest count, and the items below the threshold by name."""
    s = summary.join(pool.select(item).distinct().withColumn("_in", F.lit(True)), item, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    inside = lambda c: F.when(F.col("_in"), c)
    return s.groupBy(group).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("n") > 0).alias("rated"), F.count_if("_in").alias("pool_items"), F.count_if(F.col("_in") & (F.col("n") > 0)).alias("pool_rated"),
        F.min(inside(F.col("n"))).alias("pool_least"), F.percentile(inside(F.col("n")), F.lit(0.5)).alias("pool_median"), F.max(inside(F.col("n"))).alias("pool_greatest"), F.count_if(F.col("_in") & (F.col("n") < low_count)).alias("pool_below"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_in") & (F.col("n") < low_count), F.col(item)))), "|").alias("below_items"),
    )


def first_examples(df: DataFrame, columns: list[str], order: str, k: int = 3) -> DataFrame:
    """(column, examples): the first `k` distinct values of each column as text, in order of their first row, joined by `|`."""
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    seen = df.select(order, cells).where("value is not null").groupBy("column", "value").agg(F.min(order).alias("at"))
    first = seen.withColumn("_r", F.row_number().over(W.partitionBy("column").orderBy("at", "value"))).where(F.col("_r") <= k)
    return first.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda s: s["value"]), "|").alias("examples"))


def numeric_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, least, greatest) of the finite numbers."""
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), finite(F.col(c).cast("double")).alias("v")) for c in columns)))
    return df.select(cells).groupBy("column").agg(F.min("v").alias("least"), F.max("v").alias("greatest"))


def described(df: DataFrame, columns: list[str], near_constant: float = 0.01) -> DataFrame:
    """(column, n, mean, sd, least, q25, median, q75, greatest, cov, near_constant) of each column."""
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), finite(F.col(c).cast("double")).alias("x")) for c in columns)))
    got = df.select(cells).where("x is not null").groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("x").alias("greatest"))
    cov = F.when(F.abs(F.col("mean")) > 1e-12, F.col("sd") / F.abs(F.col("mean")))
    return got.select("column", "n", "mean", "sd", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "greatest", cov.alias("cov"), F.coalesce(cov < near_constant, F.col("sd") <= 1e-12, F.lit(True)).alias("near_constant"))


def simulation_summary(df: DataFrame, by: list[str], measures: list[str], flags: dict[str, Column]) -> DataFrame:
    """One row per condition: of every measure mean, sd, se, median, q10 and q90, of every flag its rate and sum, and the runs. One aggregate."""
    out: list[Column] = [F.count(F.lit(1)).alias("runs")]
    for m in measures:
        out += [F.count(m).alias(f"{m}_n"), F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"), F.percentile(m, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias(f"{m}_q")]
    for name, c in flags.items():
        out += [F.avg(c.cast("double")).alias(f"{name}_rate"), F.count_if(c).alias(f"{name}_total")]
    got = df.groupBy(*by).agg(*out)
    shown = [x for m in measures for x in (f"{m}_mean", f"{m}_sd", F.when(F.col(f"{m}_n") > 1, F.col(f"{m}_sd") / F.sqrt(f"{m}_n")).alias(f"{m}_se"), F.col(f"{m}_q")[1].alias(f"{m}_median"), F.col(f"{m}_q")[0].alias(f"{m}_q10"), F.col(f"{m}_q")[2].alias(f"{m}_q90"))]
    return got.select(*by, "runs", *shown, *(x for n in flags for x in (f"{n}_rate", f"{n}_total")))


def check_table(df: DataFrame, checks: dict[str, tuple[Column, Column | float | int]]) -> DataFrame:
    """(check, passed, observed, expected): `checks` maps a name to an aggregate and what it must equal (to 1e-9). One pass."""
    names = list(checks)
    got = df.agg(*(checks[n][0].cast("double").alias(f"o{k}") for k, n in enumerate(names)), *((e if isinstance(e, Column) else F.lit(float(e))).cast("double").alias(f"e{k}") for k, (_, e) in enumerate(checks.values())))
    cells = F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.abs(F.col(f"o{k}") - F.col(f"e{k}")) <= 1e-9, F.lit(False)).alias("passed"), F.col(f"o{k}").alias("observed"), F.col(f"e{k}").alias("expected")) for k, n in enumerate(names))))
    return got.select(cells)


def all_within(df: DataFrame, column: str, low: float, high: float) -> bool:
    """Whether every value lies within the limits; nulls do not count, and an empty table passes."""
    return bool(df.agg(F.coalesce(F.bool_and(F.col(column).between(low, high)), F.lit(True))).first()[0])


# draws of a fitted model

def variance_ratio_by_draw(df: DataFrame, draw: str, group: str, value: str) -> DataFrame:
    """(draw, between_var, within_var, ratio): the share of variance between groups, per draw."""
    per = df.where(F.col(value).isNotNull()).groupBy(draw, group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    got = per.groupBy(draw).agg(F.var_samp("m").alias("between_var"), F.avg("v").alias("within_var"))
    return got.withColumn("ratio", F.col("between_var") / (F.col("between_var") + F.col("within_var")))


def predictive_check(draws: DataFrame, observed: DataFrame, group: str, draw: str, value: str, low: float, high: float) -> DataFrame:
    """(group, draws, mean, mean_sd, out_of_range, observed_mean, observed_sd, above): predicted means and spreads averaged over draws, the share out of range, and the share of draws whose mean is at least the observed one."""
    per = draws.groupBy(group, draw).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.avg((~F.col(value).between(low, high)).cast("double")).alias("o"))
    real = observed.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias("observed_mean"), F.stddev_samp(value).alias("observed_sd"))
    both = per.join(real, F.col(group).eqNullSafe(F.col("_g")))
    return both.groupBy(group).agg(F.count(F.lit(1)).alias("draws"), F.avg("m").alias("mean"), F.avg("s").alias("mean_sd"), F.avg("o").alias("out_of_range"), F.first("observed_mean").alias("observed_mean"), F.first("observed_sd").alias("observed_sd"), F.avg((F.col("m") >= F.col("observed_mean")).cast("double")).alias("above"))


def convergence(draws: DataFrame, parameter: str, chain: str, value: str) -> DataFrame:
    """(parameter, chains, draws, r_hat): the potential scale reduction of each parameter from its chains; null with fewer than two chains."""
    per = draws.where(F.col(value).isNotNull()).groupBy(parameter, chain).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    got = per.groupBy(parameter).agg(F.count(F.lit(1)).alias("chains"), F.sum("n").alias("draws"), F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    return got.select(parameter, "chains", "draws", F.when((F.col("chains") > 1) & (F.col("w") > 0), F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w"))).alias("r_hat"))


def convergence_rules(table: DataFrame, r_hat: str = "r_hat", ess: Column | None = None, divergences: Column | None = None) -> DataFrame:
    """Adds `strict` (r-hat to 1.01, ESS from 400, no divergence) and `operational` (r-hat to 1.05, ESS from 100, no divergence)."""
    ess = F.lit(float("inf")) if ess is None else ess
    none = F.lit(True) if divergences is None else divergences == 0
    rule = lambda r, e: F.coalesce((F.col(r_hat) <= r) & (ess >= e) & none, F.lit(False))
    return table.withColumn("strict", rule(1.01, 400)).withColumn("operational", rule(1.05, 100))


def recommended_size(df: DataFrame, scenario: str, size: str, passes: str) -> DataFrame:
    """One row (size, rule): the least size that passes in every scenario; else the least that passes in most of them; else the greatest size."""
    of = df.agg(F.count_distinct(scenario).alias("of"), F.max(size).alias("greatest"))
    per = df.groupBy(size).agg(F.count_distinct(F.when(F.col(passes), F.col(scenario))).alias("k"))
    got = per.join(F.broadcast(of)).groupBy("greatest").agg(F.min(F.when(F.col("k") == F.col("of"), F.col(size))).alias("every"), F.min(F.when((F.col("k") > 0) & (F.col("k") * 2 > F.col("of")), F.col(size))).alias("most"))
    return got.select(F.coalesce("every", "most", "greatest").alias("size"), F.when(F.col("every").isNotNull(), "all_scenarios").when(F.col("most").isNotNull(), "most_scenarios").otherwise("greatest_size").alias("rule"))


def predictor(df: DataFrame, key: list[str], coefficients: DataFrame, features: list[str], context: str | None = None) -> DataFrame:
    """(*key, eta): the sum of coefficient x feature; `coefficients` has (term, beta) and, with a context, (context, term, beta), where a null context holds in every context. The term `intercept` has feature 1.

    The coefficient table has a row per term and context, and is gathered into a map per context.
    """
    terms = F.inline(F.array(F.struct(F.lit("intercept").alias("term"), F.lit(1.0).alias("x")), *(F.struct(F.lit(f).alias("term"), F.col(f).cast("double").alias("x")) for f in features)))
    long = df.select(*key, *([context] if context and context not in key else []), terms)
    c = coefficients.select(F.col("term").alias("_t"), "beta", *([F.col(context).alias("_c")] if context else []))
    on = F.col("term") == F.col("_t")
    if context:
        on = on & (F.col("_c").isNull() | (F.col("_c") == F.col(context)))
    return long.join(c, on).groupBy(*key).agg(F.sum(F.col("beta") * F.col("x")).alias("eta"))


def prediction_checks(df: DataFrame, group: str, probability: str, candidates: int = 3) -> DataFrame:
    """(group, check, passed): the number of candidates, probabilities within 0..1 that add up to 1, and one winner."""
    p = F.col(probability)
    got = df.groupBy(group).agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.bool_and(p.between(0, 1)), F.lit(False)).alias("r"), F.sum(p).alias("s"), F.max(p).alias("m"), F.collect_list(F.round(p, 12)).alias("v"))
    rows = {"candidates": F.col("k") == candidates, "within_0_1": F.col("r"), "adds_up_to_1": F.abs(F.col("s") - 1) <= 1e-6, "one_winner": F.size(F.filter("v", lambda x: x == F.round("m", 12))) == 1}
    return got.select(group, F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rows.items()))))


# keys and sets

def members_of(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key, of one or several columns, is in a table of keys."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def require_subset(inner: DataFrame, outer: DataFrame, on: list[str]) -> None:
    """Raise ValueError if a key of `inner` is not in `outer`."""
    lacking = inner.join(outer, on, "left_anti").limit(3).select(*on).collect()
    if lacking:
        raise ValueError(f"keys outside the other table: {[tuple(r) for r in lacking]}")


def require_keys(df: DataFrame, on: list[str]) -> None:
    """Raise ValueError if a key repeats."""
    n = df.groupBy(*on).count().where("count > 1").limit(1).count()
    if n:
        raise ValueError(f"repeated keys of {', '.join(on)}")


def require_population(observed: DataFrame, expected: DataFrame, on: list[str]) -> None:
    """Raise ValueError if the two tables do not hold the same keys."""
    require_subset(observed, expected, on)
    require_subset(expected, observed, on)


def retained(df: DataFrame, confidence: str, least: float) -> DataFrame:
    """Adds `retained` and `reason` by a threshold of confidence; rows are kept."""
    ok = F.coalesce(F.col(confidence) >= least, F.lit(False))
    return df.withColumn("retained", ok).withColumn("reason", F.when(ok, "").otherwise(F.concat(F.lit("confidence below "), F.format_string("%.2f", F.lit(least)))))


def first_per_source(df: DataFrame, group: list[str], source: str, order: list[Column], k: int) -> DataFrame:
    """Per group the first row of each source in order, and of those the first `k`; rows without a source count on their own."""
    own = F.when(F.coalesce(F.trim(source), F.lit("")) != "", F.col(source))
    one = df.withColumn("_s", own).withColumn("_r", F.row_number().over(W.partitionBy(*group, "_s").orderBy(*order))).where("_s is null or _r = 1")
    return one.withColumn("position", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("position") <= k).drop("_s", "_r")


def reference_row(df: DataFrame, group: str, item: str, duration: str, rate: str, penalties: list[Column]) -> DataFrame:
    """(group, item, score): the row nearest the group's median duration, plus 1 if its rate is not the commonest (the least of several), plus penalties; ties to the lower item."""
    mid = df.groupBy(group).agg(F.percentile(duration, F.lit(0.5)).alias("_mid"))
    common = df.groupBy(group, rate).agg(F.count(F.lit(1)).alias("_k")).groupBy(F.col(group).alias("_g")).agg(F.min(F.struct((-F.col("_k")).alias("k"), F.col(rate).alias("r"))).alias("_c"))
    score = F.abs(F.col(duration) - F.col("_mid")) + F.when(F.col(rate).eqNullSafe(F.col("_c.r")), 0.0).otherwise(1.0)
    score = reduce(lambda a, b: a + b, penalties, score)
    both = df.join(mid, group).join(common, F.col(group) == F.col("_g"))
    return both.groupBy(group).agg(F.min(F.struct(F.round(score, 9).alias("score"), F.col(item).alias("item"))).alias("m")).select(group, F.col("m.item").alias(item), "m.score")


def lookup_all(df: DataFrame, tables: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """`df` joined with several tables by the same key; each must hold every key once, else ValueError names it. Other columns of equal name get the table's name as prefix."""
    out = df
    for name, t in tables.items():
        try:
            require_keys(t, on)
            require_subset(df, t, on)
        except ValueError as e:
            raise ValueError(f"{name}: {e}") from e
        clash = [c for c in t.columns if c in out.columns and c not in on]
        out = out.join(t.withColumnsRenamed({c: f"{name}_{c}" for c in clash}), on)
    return out
