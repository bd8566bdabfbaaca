"""References to records that do not exist: orphan detection with validity periods.

Parents and children are brought to one long form `(ref_field, ref_key, ...)` and tagged; the union is grouped by
parent table and key. A group without a parent tag holds only orphans. A group with one is an orphan's group only if
some of its references lie outside the parent's periods. Only those suspect keys go back to the child rows.

Children are counted per key before the union (map-side), so a key that holds a third of all rows costs one row per
task there. The suspect keys are broadcast after a check of their rows and bytes; beyond the bounds the join is salted,
so that a hot key is spread over many tasks.

Defined results:
* null or blank reference: no reference, never an orphan;
* repeated parent rows: as one; several periods of one id: a reference must lie in any of them;
* a null start means always, a null end means still; the start belongs to the period, the end does not;
* a reference without any time is an orphan only if its key has no parent at all;
* repeated child rows: one result row each; empty tables: no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.text import id_key
from tonelake.sources.tables import BROADCAST_ROWS, join_small


@dataclass(frozen=True)
class Parent:
    """A referred table: `field` of the child refers to `key`; a row holds from `start` until before `end`."""

    field: str
    table: str
    rows: DataFrame
    key: str
    start: str | None = None
    end: str | None = None


def references(children: DataFrame, row_id: str, fields: list[str], times: list[str]) -> DataFrame:
    """Long form (row_id, at, ref_field, ref_key) of the non-blank references."""
    pairs = F.array(*(F.struct(F.lit(f).alias("ref_field"), id_key(F.col(f).cast("string")).alias("ref_key")) for f in fields))
    return (
        children.select(F.col(row_id).alias("row_id"), F.coalesce(*(F.col(t).cast("timestamp_ntz") for t in times)).alias("at"), F.inline(pairs))
        .where(F.col("ref_key").isNotNull())
    )


def _parent_rows(parents: list[Parent]) -> DataFrame:
    out = None
    for p in parents:
        when = [(F.col(c) if c else F.lit(None)).cast("timestamp_ntz") for c in (p.start, p.end)]
        one = p.rows.select(F.lit(p.field).alias("ref_field"), id_key(F.col(p.key).cast("string")).alias("ref_key"), F.struct(when[0].alias("start"), when[1].alias("end")).alias("period")).where("ref_key is not null")
        out = one if out is None else out.unionByName(one)
    return out


def _holds(periods: Column, first: Column, last: Column) -> Column:
    return F.exists(periods, lambda p: (p["start"].isNull() | (p["start"] <= first)) & (p["end"].isNull() | (last < p["end"])))


def key_groups(refs: DataFrame, parents: list[Parent]) -> DataFrame:
    """One row per (ref_field, ref_key): parent_flag, periods, refs, first_at, last_at."""
    long = "struct<start:timestamp_ntz,end:timestamp_ntz>"
    tagged_children = (
        refs.groupBy("ref_field", "ref_key")
        .agg(F.count(F.lit(1)).alias("refs"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
        .select("ref_field", "ref_key", F.lit(0).alias("is_parent"), F.lit(None).cast(long).alias("period"), "refs", "first_at", "last_at")
    )
    tagged_parents = _parent_rows(parents).select(
        "ref_field", "ref_key", F.lit(1).alias("is_parent"), "period", F.lit(0).cast("bigint").alias("refs"), *(F.lit(None).cast("timestamp_ntz").alias(c) for c in ("first_at", "last_at"))
    )
    return tagged_parents.unionByName(tagged_children).groupBy("ref_field", "ref_key").agg(
        F.max("is_parent").alias("parent_flag"), F.collect_set("period").alias("periods"), F.sum("refs").alias("refs"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )


def suspect_keys(groups: DataFrame) -> DataFrame:
    """Referred keys that lack a parent or whose periods do not cover all of their references at once."""
    covered = _holds(F.col("periods"), F.col("first_at"), F.col("last_at"))
    return groups.where((F.col("refs") > 0) & ((F.col("parent_flag") == 0) | (F.col("first_at").isNotNull() & ~covered))).select("ref_field", "ref_key", "parent_flag", "periods")


def _is_orphan() -> Column:
    return (F.col("parent_flag") == 0) | (F.col("at").isNotNull() & ~_holds(F.col("periods"), F.col("at"), F.col("at")))


_KEY = ["ref_field", "ref_key"]


def orphans(refs: DataFrame, parents: list[Parent], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The orphan references: (row_id, at, ref_field, ref_key)."""
    return join_small(refs, suspect_keys(key_groups(refs, parents)), _KEY, "row_id", rows=broadcast_rows).where(_is_orphan()).select("row_id", "at", *_KEY)


def orphan_report(refs: DataFrame, parents: list[Parent], period: str = "yyyy-MM", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per referred table and period: references, orphans, and those whose key no parent row has at all.

    References are counted per key and period, and the counts are summed; rows are looked at again only for the keys and
    periods in which a parent row begins or ends.
    """
    name = F.create_map(*(F.lit(x) for p in parents for x in (p.field, p.table)))
    dated = refs.withColumn("period", F.coalesce(F.date_format("at", period), F.lit("unknown")))
    cells = dated.groupBy(*_KEY, "period").agg(F.count(F.lit(1)).alias("refs"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    judged = join_small(cells, suspect_keys(key_groups(refs, parents)), _KEY, "period", "left", broadcast_rows)
    timed = F.col("first_at").isNotNull()
    touched = F.exists("periods", lambda p: (p["start"].isNull() | (p["start"] <= F.col("last_at"))) & (p["end"].isNull() | (F.col("first_at") < p["end"])))
    verdict = F.when(F.col("parent_flag").isNull() | ~((F.col("parent_flag") == 0) | timed), "none").when(F.col("parent_flag") == 0, "all").when(_holds(F.col("periods"), F.col("first_at"), F.col("last_at")), "none").when(~touched, "all").otherwise("some")
    judged = judged.withColumn("verdict", verdict)
    some = judged.where("verdict = 'some'").select(*_KEY, "period", "parent_flag", "periods")
    within = join_small(dated, some, [*_KEY, "period"], "row_id", rows=broadcast_rows).where(_is_orphan()).groupBy(*_KEY, "period").agg(F.count(F.lit(1)).alias("within"))
    counted = judged.join(within, [*_KEY, "period"], "left")
    orphan = F.when(F.col("verdict") == "all", F.col("refs")).when(F.col("verdict") == "some", F.coalesce("within", F.lit(0))).otherwise(F.lit(0))
    return (
        counted.select(name[F.col("ref_field")].alias("ref_table"), "period", "refs", orphan.cast("bigint").alias("orphan"), F.when(F.col("parent_flag") == 0, F.col("refs")).otherwise(F.lit(0)).cast("bigint").alias("missing"))
        .groupBy("ref_table", "period")
        .agg(F.sum("refs").alias("refs"), F.sum("orphan").alias("orphans"), F.sum("missing").alias("without_parent"))
    )
