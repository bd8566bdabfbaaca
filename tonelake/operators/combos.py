"""Ranking of combinations: triples and five-of-six subsets under weighted objectives with deterministic ties.

Triples come from three edges joined on the group and two members each (equi keys throughout), so a group of n members
gives C(n, 3) rows and no more. Ranks are windows over a group's triples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def triples(e: DataFrame) -> DataFrame:
    """(grp, a, b, c, dab, dac, dbc, min_d, mean_d) for a < b < c."""
    ab = e.select("grp", F.col("i").alias("a"), F.col("j").alias("b"), F.col("d").alias("dab"))
    ac = e.select("grp", F.col("i").alias("a"), F.col("j").alias("c"), F.col("d").alias("dac"))
    bc = e.select("grp", F.col("i").alias("b"), F.col("j").alias("c"), F.col("d").alias("dbc"))
    out = ab.join(ac, ["grp", "a"]).where("b < c").join(bc, ["grp", "b", "c"])
    return out.withColumn("min_d", F.least("dab", "dac", "dbc")).withColumn("mean_d", (F.col("dab") + F.col("dac") + F.col("dbc")) / 3)


def best_triples(t: DataFrame, must_hold: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """Per group the triple with the greatest least distance, then mean distance (both to `digits`), then the first in order. `must_hold` (grp, medoid) names a required member."""
    if must_hold is not None:
        t = t.join(must_hold.select("grp", "medoid"), "grp").where("medoid in (a, b, c)")
    # one aggregate: the first triple of the order is the least of these structs
    first = F.min(F.struct((-F.round("min_d", digits)).alias("x"), (-F.round("mean_d", digits)).alias("y"), "a", "b", "c", *(c for c in t.columns if c not in ("grp", "a", "b", "c")))).alias("_b")
    return t.groupBy("grp").agg(first).select("grp", "_b.*").drop("x", "y")


def medoid_triples(t: DataFrame, all_edges: DataFrame, digits: int = 9) -> DataFrame:
    """Exact 3-medoids: per group the triple with the least sum of distances to the nearest of the three, then the greater mean distance, then the first in order.

    Each member holds its distances to all members of its group as an array, so a triple costs one row.
    """
    rows = all_edges.groupBy("grp", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "d"))), lambda x: x["d"]).alias("_d"))
    own = t.select("grp", "a", "b", "c", "mean_d")
    for m in "abc":
        own = own.join(rows.select("grp", F.col("i").alias(m), F.col("_d").alias(f"_{m}")), ["grp", m])
    least = F.zip_with(F.zip_with("_a", "_b", lambda x, y: F.least(x, y)), "_c", lambda x, y: F.least(x, y))
    inertia = own.select("grp", "a", "b", "c", "mean_d", F.round(F.aggregate(least, F.lit(0.0), lambda s, v: s + v), digits).alias("inertia"))
    first = F.min(F.struct("inertia", (-F.round("mean_d", digits)).alias("m"), "a", "b", "c")).alias("b")
    return inertia.groupBy("grp").agg(first).select("grp", "b.a", "b.b", "b.c", "b.inertia")


def min_max(c: str, group: list[str], flat: float = 0.0) -> Column:
    """Min-max normalised within the group; `flat` where all are equal."""
    g = W.partitionBy(*group)
    low, high = F.min(c).over(g), F.max(c).over(g)
    return F.when(high - low > 1e-12, (F.col(c) - low) / (high - low)).otherwise(flat)


def with_tertiles(scores: DataFrame) -> DataFrame:
    """Adds `third` (0 low, 1 medium, 2 high) by the group's own 1/3 and 2/3 quantiles of `score`; both limits belong to the outer thirds."""
    t = scores.groupBy("grp").agg(F.percentile("score", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_t"))
    third = F.when(F.col("score") <= F.col("_t")[0] + 1e-9, 0).when(F.col("score") >= F.col("_t")[1] - 1e-9, 2).otherwise(1)
    return scores.join(t, "grp").withColumn("third", third).drop("_t")


def quality_status(flagged: Column, low_count: Column) -> Column:
    """review before caution before clear."""
    return F.when(flagged, "review").when(low_count, "caution").otherwise("clear")


def triple_objective(t: DataFrame, scores: DataFrame, acoustic: float = 0.8, rating: float = 0.2, review: float = 0.05, caution: float = 0.025) -> DataFrame:
    """Both conditions (wide and similar ratings) of each triple of rated members: objective from normalised distances and rating spread.

    acoustic * (0.7 norm(min distance) + 0.3 norm(mean distance)) + rating * (norm(spread), or 1 - that for similar)
    + 0.03 if wide and the three lie in three different thirds - the penalties of members under review or caution.
    `scores`: (grp, idx, name, score, third, status), rated members only. `number` counts a group's triples before ranking.
    """
    s = lambda m: scores.select("grp", F.col("idx").alias(m), F.col("name").alias(f"n{m}"), F.col("score").alias(f"s{m}"), F.col("third").alias(f"t{m}"), F.when(F.col("status") == "review", review).when(F.col("status") == "caution", caution).otherwise(0.0).alias(f"p{m}"))
    out = t.join(s("a"), ["grp", "a"]).join(s("b"), ["grp", "b"]).join(s("c"), ["grp", "c"])
    out = out.withColumn("spread", F.greatest("sa", "sb", "sc") - F.least("sa", "sb", "sc")).withColumn("names", F.concat_ws("|", "na", "nb", "nc"))
    out = out.withColumn("near", min_max("min_d", ["grp"])).withColumn("far", min_max("mean_d", ["grp"])).withColumn("wide", min_max("spread", ["grp"]))
    out = out.withColumn("number", F.row_number().over(W.partitionBy("grp").orderBy("a", "b", "c")))
    varied = (F.col("ta") != F.col("tb")) & (F.col("ta") != F.col("tc")) & (F.col("tb") != F.col("tc"))
    base = acoustic * (0.7 * F.col("near") + 0.3 * F.col("far")) - (F.col("pa") + F.col("pb") + F.col("pc"))
    both = F.inline(F.array(
        F.struct(F.lit("wide").alias("condition"), (base + rating * F.col("wide") + F.when(varied, 0.03).otherwise(0.0)).alias("objective")),
        F.struct(F.lit("similar").alias("condition"), (base + rating * (1 - F.col("wide"))).alias("objective")),
    ))
    return out.select("grp", "number", "a", "b", "c", "names", "min_d", "mean_d", "spread", both)


def ranked(t: DataFrame, digits: int = 9) -> DataFrame:
    """Adds `rank` per group and condition: objective, least and mean distance, then the joined names, all descending."""
    order = [F.desc(F.round("objective", digits)), F.desc(F.round("min_d", digits)), F.desc(F.round("mean_d", digits)), F.desc("names")]
    return t.withColumn("rank", F.row_number().over(W.partitionBy("grp", "condition").orderBy(*order)))


def least_overlap(r: DataFrame, digits: int = 9) -> DataFrame:
    """Per group the wide triple that shares fewest members with the best similar one, then by objective and least distance."""
    best = r.where("condition = 'similar' and rank = 1").select("grp", F.split("names", r"\|").alias("other"))
    wide = r.where("condition = 'wide'").join(best, "grp").withColumn("overlap", F.size(F.array_intersect(F.split("names", r"\|"), "other")))
    order = ["overlap", F.desc(F.round("objective", digits)), F.desc(F.round("min_d", digits)), "names"]
    return wide.withColumn("_r", F.row_number().over(W.partitionBy("grp").orderBy(*order))).where("_r = 1").drop("_r", "other")


def six_members(r: DataFrame, disjoint: bool = False) -> DataFrame:
    """(grp, members, shared): the best similar triple united with the wide triple that shares least with it. With `disjoint`, raises ValueError where they share a member."""
    wide = least_overlap(r).select("grp", F.split("names", r"\|").alias("w"), "overlap")
    got = r.where("condition = 'similar' and rank = 1").select("grp", F.split("names", r"\|").alias("s")).join(wide, "grp")
    got = got.select("grp", F.array_sort(F.array_union("s", "w")).alias("members"), F.col("overlap").alias("shared"))
    if disjoint and got.where("shared > 0").limit(1).count():
        raise ValueError("the two triples of a group share a member")
    return got


def subsets_of_one_less(sets: DataFrame, set_id: str, members: str) -> DataFrame:
    """(set_id, left_out, member): every subset that leaves one member out, in long form."""
    m = F.explode(members)
    return sets.select(set_id, members, m.alias("left_out")).select(set_id, "left_out", F.explode(F.array_except(members, F.array("left_out"))).alias("member"))


def subset_scores(long: DataFrame, set_id: str, pair_edges: DataFrame, ratings: DataFrame, near: float) -> DataFrame:
    """Scores subsets: .38 least + .25 median distance + .22 rating range + .15 similarity - .5 per near pair.

    `pair_edges`: (set_id, m, n, d) with m < n; `ratings`: (member, rating). Distances and ratings are min-max normalised over a set's subsets (0.5 where flat); similarity is 1
    where the closest three ratings lie within .08, else it falls linearly to 0 where the closest two are .18 apart. `rank` by score, least and median distance.
    """
    a = long.select(set_id, "left_out", F.col("member").alias("m"))
    b = long.select(set_id, "left_out", F.col("member").alias("n"))
    d = a.join(b, [set_id, "left_out"]).where("m < n").join(pair_edges, [set_id, "m", "n"]).groupBy(set_id, "left_out").agg(F.min("d").alias("min_d"), F.percentile("d", F.lit(0.5)).alias("median_d"), F.count_if(F.col("d") <= near).alias("near_pairs"))
    w = W.partitionBy(set_id, "left_out").orderBy("rating")
    rated = long.join(ratings, "member").where("rating is not null").withColumn("gap", F.col("rating") - F.lag("rating").over(w)).withColumn("span3", F.col("rating") - F.lag("rating", 2).over(w))
    r = rated.groupBy(set_id, "left_out").agg((F.max("rating") - F.min("rating")).alias("rating_range"), F.min("gap").alias("closest_pair"), F.min("span3").alias("closest_triple"))
    out = d.join(r, [set_id, "left_out"], "left").withColumn("rating_range", F.coalesce("rating_range", F.lit(0.0)))
    similar = F.when(F.col("closest_triple") <= 0.08, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("closest_pair", F.lit(1.0)) / F.lit(0.18)))
    n = lambda c: min_max(c, [set_id], 0.5)
    out = out.withColumn("similarity", similar).withColumn("score", 0.38 * n("min_d") + 0.25 * n("median_d") + 0.22 * n("rating_range") + 0.15 * F.col("similarity") - 0.5 * F.col("near_pairs"))
    order = [F.desc(F.round("score", 9)), F.desc(F.round("min_d", 9)), F.desc(F.round("median_d", 9)), "left_out"]
    return out.withColumn("rank", F.row_number().over(W.partitionBy(set_id).orderBy(*order)))


def replacement_scores(best: DataFrame, reliability: Column) -> DataFrame:
    """Adds `replacement`: .35 least + .20 median distance + 1.2 rating range + .75 reliability of each set's best subset."""
    return best.withColumn("replacement", 0.35 * F.col("min_d") + 0.20 * F.col("median_d") + 1.2 * F.col("rating_range") + 0.75 * reliability)


def status_reliability(status: str) -> Column:
    """Aggregate: the share of PASS, REVIEW counting .65."""
    return (F.count_if(F.col(status) == "PASS") + 0.65 * F.count_if(F.col(status) == "REVIEW")) / F.greatest(F.count(F.lit(1)), F.lit(1))
