"""Choosing a varied subset: distributed farthest-first k-center.

The pool of each group is split into blocks. Within a block representatives are chosen greedily: the next one is the
member farthest from those chosen. The blocks' representatives are pooled and farthest-first runs again, until the
wanted size, or until every member lies within `radius` of a representative (the number of kinds, where kinds are
disjoint and clearly apart). No pair list is ever built: a block of n members costs n distances per representative.

Pools above `block` members are salted over several tasks; a group's first representative is the member nearest its
mean, then ties go to the lower id, so results are repeatable.

Defined results: members with a null, NaN or infinite coordinate are no members; repeated members count once (the
lowest row id); an empty pool gives no rows; a pool smaller than the wanted size is taken whole; extra columns are
ignored; unknown ids in a selection are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions.numeric import is_finite
from tonelake.sources.tables import join_small

#: Members of one block: 5,000 x 8 doubles and one distance column each stay within a few MB.
BLOCK = 5_000


def pools(df: DataFrame, group: str, member: str, row_id: str, coordinates: list[str], extra: list[str] | None = None) -> DataFrame:
    """(grp, member, vec, *extra): the distinct members of each group with all coordinates."""
    whole = None
    for c in coordinates:
        ok = is_finite(F.col(c).cast("double"))
        whole = ok if whole is None else whole & ok
    kept = df.where(whole & F.col(group).isNotNull() & F.col(member).isNotNull())
    row = F.struct(F.col(row_id).alias("r"), F.array(*(F.col(c).cast("double") for c in coordinates)).alias("vec"), *(F.col(x) for x in extra or []))
    return kept.groupBy(F.col(group).alias("grp"), F.col(member).alias("member")).agg(F.min_by(row, F.col(row_id)).alias("m")).select("grp", "member", "m.vec", *(f"m.{x}" for x in extra or []))


def farthest_first(vectors: np.ndarray, size: int | None, radius: float | None) -> list[int]:
    """Indices chosen greedily, in order; rows must be in id order, so that ties go to the lower id."""
    if not len(vectors):
        return []
    centre = vectors.mean(axis=0)
    chosen = [int(np.argmin(((vectors - centre) ** 2).sum(axis=1)))]
    near = np.sqrt(((vectors - vectors[chosen[0]]) ** 2).sum(axis=1))
    while size is None or len(chosen) < min(size, len(vectors)):
        k = int(np.argmax(near))
        if near[k] <= 0 and (radius is not None or size is None):
            break
        if radius is not None and near[k] < radius:
            break
        if near[k] <= 0:  # only copies are left: take those not chosen yet
            chosen += [i for i in range(len(vectors)) if i not in set(chosen)][: min(size, len(vectors)) - len(chosen)]
            break
        chosen.append(k)
        near = np.minimum(near, np.sqrt(((vectors - vectors[k]) ** 2).sum(axis=1)))
    return chosen


def _blocks(pool: DataFrame, block: int) -> DataFrame:
    """(grp, member, vec, salt): large groups are spread over several blocks."""
    sizes = pool.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > block)
    return join_small(pool.select("grp", "member", "vec"), sizes, ["grp"], "member", "left").withColumn("salt", F.pmod(F.xxhash64("member"), F.coalesce(F.ceil(F.col("members") / F.lit(block)), F.lit(1)))).drop("members")


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["vec"].tolist(), dtype=float).reshape(len(pdf), -1)


def representatives(pool: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """(grp, member, vec, position): `size` members chosen by farthest-first in blocks and again over the blocks' choices."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member", kind="stable").reset_index(drop=True)
        at = farthest_first(_vectors(pdf), size, None)
        return pd.DataFrame({"grp": pdf["grp"].iloc[at].to_numpy(), "member": pdf["member"].iloc[at].to_numpy(), "vec": [list(map(float, v)) for v in pdf["vec"].iloc[at]], "position": range(1, len(at) + 1)})

    schema = "grp string, member string, vec array<double>, position int"
    local = _blocks(pool, block).groupBy("grp", "salt").applyInPandas(lambda pdf: choose(pdf), schema)
    return local.drop("position").groupBy("grp").applyInPandas(choose, schema)


def distance(a: str, b: str) -> F.Column:
    return F.sqrt(F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def kinds(pool: DataFrame, radius: float, block: int = BLOCK) -> DataFrame:
    """(grp, member, kind, pool_kinds): each member's kind, named by a representative, and the number of kinds of its pool.

    A block chooses its representatives and gives each of its members the nearest one at once; the blocks'
    representatives alone are pooled, and farthest-first over them tells which of them are of one kind. So no member
    ever meets the representatives of another block.
    """

    def nearest(v: np.ndarray, at: list[int]) -> np.ndarray:
        """For each row the nearest of the chosen rows; ties go to the lower id."""
        order = np.array(sorted(at))
        best, least = np.full(len(v), order[0]), np.full(len(v), np.inf)
        for k in order:
            d = ((v - v[k]) ** 2).sum(axis=1)
            closer = d < least
            best[closer], least[closer] = k, d[closer]
        return best

    def arranged(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        t = t.sort_by("member").combine_chunks()
        flat = t.column("vec").combine_chunks()
        return t, flat.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def within(t: pa.Table) -> pa.Table:
        t, v = arranged(t)
        near = nearest(v, farthest_first(v, None, radius))
        own = pa.array(near == np.arange(len(v)))
        rep = t.column("member").take(pa.array(near))
        return pa.table({"grp": t.column("grp"), "member": t.column("member"), "rep": rep, "vec": pc.if_else(own, t.column("vec"), None)})

    def across(t: pa.Table) -> pa.Table:
        t, v = arranged(t)
        near = nearest(v, farthest_first(v, None, radius))
        return pa.table({"grp": t.column("grp"), "rep": t.column("member"), "kind": t.column("member").take(pa.array(near)), "pool_kinds": pa.array(np.full(len(v), len(set(near.tolist())), dtype=np.int64))})

    local = _blocks(pool, block).groupBy("grp", "salt").applyInArrow(within, "grp string, member string, rep string, vec array<double>").persist(StorageLevel.MEMORY_AND_DISK)
    reps = local.where("vec is not null").select("grp", "member", "vec").groupBy("grp").applyInArrow(across, "grp string, rep string, kind string, pool_kinds bigint")
    return join_small(local.select("grp", "member", "rep"), reps, ["grp", "rep"], "member").select("grp", "member", "kind", "pool_kinds")


def selected_members(selections: DataFrame, selection: str, group: str, members: str, separator: str = r"\|") -> DataFrame:
    """(selection, grp, member), each member once."""
    parts = F.array_distinct(F.transform(F.split(F.col(members), separator), lambda x: F.btrim(x, F.lit(" \t"))))
    return selections.select(F.col(selection).alias("selection"), F.col(group).alias("grp"), F.explode(parts).alias("member")).where("member <> ''")


def crowded_selections(pool: DataFrame, chosen: DataFrame, radius: float) -> DataFrame:
    """Selections that hold two members of one kind although some kind of their pool is missing: (selection, members, kinds, pool_kinds)."""
    held = chosen.join(kinds(pool, radius), ["grp", "member"])
    return (
        held.groupBy("selection", "grp")
        .agg(F.count(F.lit(1)).alias("members"), F.count_distinct("kind").alias("kinds"), F.max("pool_kinds").alias("pool_kinds"))
        .where((F.col("members") > F.col("kinds")) & (F.col("kinds") < F.col("pool_kinds")))
        .select("selection", "members", "kinds", "pool_kinds")
    )


def subset_report(pool: DataFrame, size: int, institution: str) -> DataFrame:
    """One row per group: the chosen members and how varied they are."""
    chosen = representatives(pool, size=size)
    named = chosen.join(pool.select("grp", "member", F.col(institution).alias("institution")), ["grp", "member"])
    a, b = named.select("grp", F.col("position").alias("i"), F.col("vec").alias("u")), named.select(F.col("grp").alias("g"), F.col("position").alias("j"), F.col("vec").alias("v"))
    # at most size * (size - 1) / 2 pairs of a group
    pairs = a.join(b, (a["grp"] == b["g"]) & (a["i"] < b["j"])).groupBy("grp").agg(F.min(distance("u", "v")).alias("minimum_pairwise_distance"), F.avg(distance("u", "v")).alias("mean_pairwise_distance"))
    sets = named.groupBy("grp").agg(
        F.count(F.lit(1)).alias("subset_size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "member"))), lambda x: x["member"]), "|").alias("mix_ids"), F.count_distinct(F.nullif(F.trim("institution"), F.lit(""))).alias("unique_institution_count")
    )
    return sets.join(pairs, "grp", "left")
