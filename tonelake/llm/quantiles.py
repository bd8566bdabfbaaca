"""Exact percentiles of large numeric columns by radix selection, and summaries of days that can be merged.

A double maps to an order-preserving 64-bit integer. Each round counts one digit of it per group, adds the counts up
and follows only the digit that holds each target rank; after the last digit the value is known exactly, so the rank
error is zero. Every round has map-side counts of at most 65,536 cells per group, however large the group is, and keeps
only the rows in followed cells for the next one: rows shrink with each digit. The followed prefixes (groups x
percentiles) are broadcast only after a check of their size.

`radix_summary` counts digits per group and day, and splits a cell further only while it holds more than a share of its
day's rows. Summaries of any days or partitions may be concatenated; `summary_percentiles` reads percentiles off them
without the rows. Its rank error is at most the share: of each day, at most that share lies in the cell that is cut.

Defined results: null, NaN and infinite values are left out, and values outside [low, high] where given; percentile p
of n values is the one of rank max(1, ceil(p n)); -0.0 counts as 0.0; a group without values gives no row; null groups
are groups; repeated rows count as they stand; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions.numeric import is_finite
from tonelake.sources.tables import BROADCAST_ROWS, bounded, cut, release

#: Right shifts of the digits, most significant first; each digit has 16 bits.
SHIFTS = (48, 32, 16, 0)
_TWO52 = 4503599627370496


def to_ordered(c: Column) -> Column:
    """A finite double as a BIGINT of the same order, from its IEEE exponent and fraction."""
    a = F.abs(c)
    guess = F.floor(F.log2(a))
    e = F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess)
    bits = (
        F.when(a == 0, F.lit(0).cast("bigint"))
        .when(a < 2.0**-1022, (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint"))
        .otherwise((e + 1023) * F.lit(_TWO52).cast("bigint") + ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(_TWO52))).cast("bigint"))
    )
    return F.when(c < 0, -bits - 1).otherwise(bits)


def from_ordered(k: Column) -> Column:
    """The inverse of `to_ordered`."""
    bits = F.when(k < 0, -k - 1).otherwise(k)
    e, m = F.shiftright(bits, 52), bits.bitwiseAND(F.lit(_TWO52 - 1))
    a = F.when(e == 0, m * F.lit(2.0**-537) * F.lit(2.0**-537)).otherwise((1 + m / F.lit(float(_TWO52))) * F.pow(F.lit(2.0), e - 1023))
    return F.when(k < 0, -a).otherwise(a)


def ordered_values(df: DataFrame, by: list[str], measures: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Long form (*by, measure, key) of the values that count."""
    cells = F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures)))
    long = df.select(*by, cells).where(is_finite(F.col("value")))
    if low is not None:
        long = long.where(F.col("value") >= low)
    if high is not None:
        long = long.where(F.col("value") <= high)
    return long.select(*by, "measure", to_ordered(F.col("value")).alias("key"))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_{c}"]) for c in columns))


def digit_counts(keyed: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of the first digit per group."""
    return keyed.groupBy(*groups, F.shiftright("key", SHIFTS[0]).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def _with_ranks(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Adds `below`, the rows in smaller digits of the group, and `total`."""
    up_to = F.sum("n").over(W.partitionBy(*groups).orderBy("digit").rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("below", up_to - F.col("n")).withColumn("total", F.sum("n").over(W.partitionBy(*groups)))


def _rank(p: Column, total: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.round(p * total, 6)))


def _targets(ranked: DataFrame, ps: list[float], *columns) -> DataFrame:
    """The cells of `ranked` that hold the percentiles' ranks: (*columns, p, rest), rest being the rank within the cell."""
    at = F.inline(F.array(*(F.struct(F.lit(p).alias("p"), _rank(F.lit(p), F.col("total")).alias("rank")) for p in ps)))
    return ranked.select("*", at).where((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("n"))).select(*columns, "p", (F.col("rank") - F.col("below")).alias("rest"))


def percentiles(df: DataFrame, by: list[str], measures: list[str], ps: list[float], low: float | None = None, high: float | None = None) -> DataFrame:
    """(*by, measure, p, n, value): the exact percentiles `ps` of each group."""
    rows = ordered_values(df, by, measures, low, high)
    groups = [*by, "measure"]
    targets = _targets(_with_ranks(digit_counts(rows, groups), groups), ps, *groups, F.col("total").alias("of"), F.col("digit").alias("prefix"))
    written: DataFrame | None = None
    for above, shift in zip(SHIFTS, SHIFTS[1:]):
        # written, so that a round's plan does not hold the rounds before; a row has a fixed width of about a hundred bytes
        followed = cut(targets)
        hint = F.broadcast if followed.count() <= BROADCAST_ROWS else lambda x: x
        prefixes = hint(followed.select(*(F.col(c).alias(f"_{c}") for c in (*groups, "prefix"))).distinct())
        prefixed = rows.withColumn("prefix", F.shiftright("key", above))
        # only rows in followed cells go on to the next digit
        rows = cut(prefixed.join(prefixes, _same(prefixed, prefixes, [*groups, "prefix"])).select(*groups, "key"))
        release(written)
        written = rows
        cells = rows.groupBy(*groups, F.shiftright("key", above).alias("prefix"), F.shiftright("key", shift).bitwiseAND(F.lit(0xFFFF).cast("bigint")).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        counted = _with_ranks(cells, [*groups, "prefix"])
        goal = hint(followed.select(*(F.col(c).alias(f"_{c}") for c in (*groups, "prefix")), "p", "of", "rest"))
        targets = (
            counted.join(goal, _same(counted, goal, [*groups, "prefix"]))
            .where((F.col("rest") > F.col("below")) & (F.col("rest") <= F.col("below") + F.col("n")))
            .select(*groups, "p", "of", (F.shiftleft("prefix", 16) + F.col("digit")).alias("prefix"), (F.col("rest") - F.col("below")).alias("rest"))
        )
    return targets.select(*groups, "p", F.col("of").alias("n"), from_ordered(F.col("prefix")).alias("value"))


def radix_summary(df: DataFrame, by: list[str], measures: list[str], day: str, share: float = 0.005, low: float | None = None, high: float | None = None) -> DataFrame:
    """(*by, measure, day, first, last, n): counts of disjoint ranges of ordered keys per group and day; a range of several keys holds at most `share` of its day's rows."""
    groups = [*by, "measure", day]
    rows = ordered_values(df, [*by, day], measures, low, high)
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    out, open_cells = None, None
    for shift in SHIFTS:
        cells = rows.groupBy(*groups, F.shiftright("key", shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
        s = sizes.select(*(F.col(c).alias(f"_{c}") for c in groups), "_size")
        cells = cells.join(s, _same(cells, s, groups))
        done = (F.col("n") <= F.lit(share) * F.col("_size")) | (F.col("first") == F.col("last"))
        ready = cells.where(done).select(*groups, "first", "last", "n")
        out = ready if out is None else out.unionByName(ready)
        open_cells = cells.where(~done).select(*(F.col(c).alias(f"_{c}") for c in (*groups, "prefix")))
        prefixed = rows.withColumn("prefix", F.shiftright("key", shift))
        side, _ = bounded(open_cells)
        rows = prefixed.join(side, _same(prefixed, side, [*groups, "prefix"])).select(*groups, "key")
    return out


def summary_percentiles(summary: DataFrame, by: list[str], ps: list[float]) -> DataFrame:
    """(*by, measure, p, n, value) from summaries of any days or partitions, concatenated."""
    groups = [*by, "measure"]
    cells = summary.groupBy(*groups, F.col("last").alias("digit")).agg(F.sum("n").alias("n"))
    return _targets(_with_ranks(cells, groups), ps, *groups, F.col("total").alias("n"), from_ordered(F.col("digit")).alias("value")).select(*groups, "p", "n", "value")
