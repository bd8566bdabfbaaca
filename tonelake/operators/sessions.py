"""Checks of sessions, orders and answers, a randomisation audit, and report contexts.

Defined results: a session that lacks a value fails the check that needs it; sessions without an id are none; answers
that are null or blank count as not given; repeated rows count once where distinct things are counted; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions.text import is_blank
from tonelake.operators import design


def session_checks(df: DataFrame, session: str, trial: str, checks: dict[str, Column], trial_checks: dict[str, Column], trials: int | None = None) -> DataFrame:
    """(session, trials, responses, one column per check, accepted): `checks` are conditions of every row, `trial_checks` aggregates of every trial.

    All must hold for a session to be accepted; `trials` is the number of trials that a session must have.
    """
    holds = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    per = df.groupBy(session, trial).agg(F.count(F.lit(1)).alias("_n"), *(holds(c).alias(n) for n, c in checks.items()), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in trial_checks.items()))
    names = [*checks, *trial_checks]
    got = per.groupBy(session).agg(F.count(F.lit(1)).alias("trials"), F.sum("_n").alias("responses"), *(F.bool_and(n).alias(n) for n in names))
    if trials is not None:
        got = got.withColumn("trial_count", F.col("trials") == trials)
        names = [*names, "trial_count"]
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n)
    return got.withColumn("accepted", ok)


def order_checks(df: DataFrame, session: str, trial: str, block: str, item: str, per_block: int) -> DataFrame:
    """(session, blocks, contiguous, per_block, items_once): whether a session's trials keep its blocks together, each block has `per_block` trials, and no block repeats an item. `df` has a row per trial."""
    t = df.select(session, trial, block, item).distinct()
    w = W.partitionBy(session).orderBy(trial)
    starts = t.withColumn("_new", (~F.col(block).eqNullSafe(F.lag(block).over(w))).cast("int"))
    runs = starts.groupBy(session).agg(F.sum("_new").alias("_runs"))
    blocks = t.groupBy(session, block).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(item).alias("_items"))
    got = blocks.groupBy(session).agg(F.count(F.lit(1)).alias("blocks"), F.bool_and(F.col("_n") == per_block).alias("per_block"), F.bool_and(F.col("_n") == F.col("_items")).alias("items_once"))
    return got.join(runs, session).select(session, "blocks", (F.col("_runs") == F.col("blocks")).alias("contiguous"), "per_block", "items_once")


def randomisation_audit(orders: DataFrame, item: str, position: str) -> DataFrame:
    """(item, position, times, share, expected, deviation): how often each item stands at each place of simulated orders, against equal shares."""
    counts = orders.groupBy(item, position).agg(F.count(F.lit(1)).alias("times"))
    of = F.sum("times").over(W.partitionBy(item))
    places = counts.select(position).distinct().agg(F.count(F.lit(1)).alias("_p"))
    out = counts.withColumn("share", F.col("times") / of).join(F.broadcast(places))
    return out.select(item, position, "times", "share", (1 / F.col("_p")).alias("expected"), F.abs(F.col("share") - 1 / F.col("_p")).alias("deviation"))


def ungrouped_order(df: DataFrame, unit: str, segment: str, repeats: int, tries: int = 20, seed: int = 0) -> DataFrame:
    """(unit, segment, repeat, position, attempt): the first of `tries` orders of a unit's repeated segments that does not keep equal segments all together; else they take turns."""
    rows = df.select(unit, segment).distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")).select("*", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("attempt"))
    w = W.partitionBy(unit, "attempt").orderBy(design.uniform(F.col(unit), F.col(segment), F.col("repeat"), F.col("attempt"), seed=seed), segment, "repeat")
    placed = rows.withColumn("position", F.row_number().over(w))
    changes = placed.withColumn("_c", (F.col(segment) != F.lag(segment).over(W.partitionBy(unit, "attempt").orderBy("position"))).cast("int"))
    good = changes.groupBy(unit, "attempt").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_k"), F.count_distinct(segment).alias("_s")).where(F.col("_k") > F.col("_s") - 1).groupBy(unit).agg(F.min("attempt").alias("attempt"))
    turns = W.partitionBy(unit).orderBy("repeat", segment)
    fallback = placed.where("attempt = 1").join(good.select(unit), unit, "left_anti").withColumn("position", F.row_number().over(turns)).withColumn("attempt", F.lit(0))
    return placed.join(good, [unit, "attempt"]).select(unit, segment, "repeat", "position", "attempt").unionByName(fallback.select(unit, segment, "repeat", "position", "attempt"))


def missing_answers(answers: DataFrame, unit: str, fields: list[tuple[str, bool, str | None]]) -> DataFrame:
    """(unit, field): required fields not answered, and detail fields left blank although their field says `other`.

    `answers` has a map `answers`; `fields` are (field, required, detail field or None).
    """
    given = lambda f: ~is_blank(F.col("answers")[f])
    lacking = [F.when(~given(f), F.lit(f)) for f, required, _ in fields if required]
    lacking += [F.when((F.lower(F.trim(F.col("answers")[f])) == "other") & ~given(detail), F.lit(detail)) for f, _, detail in fields if detail]
    return answers.select(unit, F.explode(F.array_compact(F.array(*lacking))).alias("field"))


def allowed_answers(answers: Column, allowed: dict[str, list[str]], dependents: dict[str, list[str]]) -> Column:
    """The map without answers outside their allowed values, and then without the answers that depend on one that is gone."""
    kept = F.map_filter(answers, lambda k, v: F.coalesce(_one_of(k, v, allowed), F.lit(True)))
    for field, names in dependents.items():
        kept = F.when(F.map_contains_key(kept, field), kept).otherwise(F.map_filter(kept, lambda k, v: ~k.isin(names)))  # noqa: B023
    return kept


def _one_of(k: Column, v: Column, allowed: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("boolean")
    for field, values in allowed.items():
        out = F.when(k == field, F.coalesce(v.isin(values), F.lit(False))).otherwise(out)
    return out


def with_prefix(values: Column, prefix: str) -> Column:
    """The entries of a map whose key has the prefix and whose value is there."""
    return F.map_filter(values, lambda k, v: k.startswith(prefix) & ~is_blank(v))


def passed_screening(scores: DataFrame, unit: str, attempt: str, question: str, score: str, least: int) -> DataFrame:
    """(unit, score, passed): the sum of the last attempt's scores; a question answered again in the attempt counts once, its greatest score. Null scores are no points."""
    last = scores.join(scores.groupBy(unit).agg(F.max(attempt).alias(attempt)), [unit, attempt])
    one = last.groupBy(unit, question).agg(F.max(score).alias("s")).groupBy(unit).agg(F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("score"))
    return one.withColumn("passed", F.col("score") >= least)


def separated_pairs(edges: DataFrame, members: DataFrame, names: list[str], k: int = 2) -> DataFrame:
    """(grp, i, j, d, rank, differing): pairs from the least to the most separated, with the `k` coordinates that differ most, ties in coordinate order."""
    at = lambda c: members.select("grp", F.col("idx").alias(c), F.col("x").alias(f"_x{c}"))
    both = edges.join(at("i"), ["grp", "i"]).join(at("j"), ["grp", "j"])
    label = F.array(*(F.lit(n) for n in names))
    gaps = F.array_sort(F.transform(F.arrays_zip("_xi", "_xj", label.alias("_n")), lambda z: F.struct((-F.round(F.abs(z["_xi"] - z["_xj"]), 9)).alias("g"), F.array_position(label, z["_n"]).alias("p"), z["_n"].alias("n"))))
    rank = F.row_number().over(W.partitionBy("grp").orderBy(F.round("d", 9), "i", "j"))
    return both.select("grp", "i", "j", "d", rank.alias("rank"), F.array_join(F.transform(F.slice(gaps, 1, k), lambda s: s["n"]), ", ").alias("differing"))


def report_context(tables: dict[str, DataFrame], on: list[str], agree: dict[str, tuple[str, str]], legal: dict[str, list[str]]) -> DataFrame:
    """The first table with all others by key, columns prefixed by their table, and what the tables contradict each other in.

    `agree` names a check and the two columns that must be equal, `legal` a column and its values. `problems` joins the
    checks that fail by `;`, the tables that lack the key among them.
    """
    names = list(tables)
    prefixed = {n: t.select(*on, *(F.col(c).alias(f"{n}_{c}") for c in t.columns if c not in on), F.lit(True).alias(f"{n}_here")) for n, t in tables.items()}
    out = prefixed[names[0]]
    for n in names[1:]:
        out = out.join(prefixed[n], on, "left")
    problems = [F.when(F.col(f"{n}_here").isNull(), F.lit(f"{n}_missing")) for n in names[1:]]
    problems += [F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(check)) for check, (a, b) in agree.items()]
    problems += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(values), F.lit(f"{c}_illegal")) for c, values in legal.items()]
    return out.drop(*(f"{n}_here" for n in names)) if not problems else out.withColumn("problems", F.array_join(F.array_compact(F.array(*problems)), ";")).drop(*(f"{n}_here" for n in names))
