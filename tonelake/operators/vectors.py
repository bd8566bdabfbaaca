"""Vector analytics within groups: robust scaling, block weights, distances, medoids, neighbours, outliers, PCA, pools.

Groups are pools of tens to hundreds of members. Edges (i < j) always carry the group as an equi-join key, so no nested
loop arises, and are kept once per unordered pair. Only singular values and sequential greedy choices run in Python,
one group at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions.numeric import is_finite
from tonelake.operators import pools


def members(df: DataFrame, group: str, member: str, order: str, coordinates: list[str], keep: list[str] | None = None) -> DataFrame:
    """(grp, member, idx, x, *keep): distinct members with all coordinates finite, numbered by id within their group."""
    whole = F.col(group).isNotNull() & F.col(member).isNotNull()
    for c in coordinates:
        whole &= is_finite(F.col(c).cast("double"))
    row = F.struct(F.array(*(F.col(c).cast("double") for c in coordinates)).alias("x"), *(F.col(k) if isinstance(k, str) else k for k in keep or []))
    one = df.where(whole).groupBy(F.col(group).alias("grp"), F.col(member).alias("member")).agg(F.min_by(row, F.col(order)).alias("r"))
    kept = one.select("r.*").columns[1:]
    return one.select("grp", "member", F.row_number().over(W.partitionBy("grp").orderBy("member")).alias("idx"), "r.x", *(F.col("r").getField(n).alias(n) for n in kept))


def _long(pool: DataFrame) -> DataFrame:
    return pool.select("grp", "member", "idx", F.posexplode("x").alias("dim", "v"))


def robust_scale(pool: DataFrame) -> DataFrame:
    """`pool` with x as (x - median) / IQR per group and dimension; dimensions of IQR <= 1e-10 become zeros and are kept."""
    q = _long(pool).groupBy("grp", "dim").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    params = q.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "q"))), lambda s: s["q"]).alias("params"))
    iqr = lambda q: q[2] - q[0]
    scaled = F.zip_with("x", "params", lambda v, q: F.when(iqr(q) > 1e-10, (v - q[1]) / iqr(q)).otherwise(0.0))
    return pool.join(params, "grp").withColumn("x", scaled).drop("params")


def block_weight(pool: DataFrame) -> DataFrame:
    """`pool` with x divided by the root of the group's mean squared norm (which then is 1); all zeros where that is <= 1e-12."""
    norm2 = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    mean2 = F.avg("_n2").over(W.partitionBy("grp"))
    return pool.withColumn("_n2", norm2).withColumn("_w", F.sqrt(mean2)).withColumn("x", F.transform("x", lambda v: F.when(F.col("_w") > 1e-12, v / F.col("_w")).otherwise(0.0))).drop("_n2", "_w")


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


def euclidean_of(width: int):
    """Euclidean distance of arrays of a known width, written out term by term, so that it is compiled instead of interpreted."""

    def metric(a: Column, b: Column) -> Column:
        total = F.lit(0.0)
        for k in range(width):
            gap = F.get(a, k) - F.get(b, k)
            total = total + gap * gap
        return F.sqrt(total)

    return metric


def edges(pool: DataFrame, metric=euclidean) -> DataFrame:
    """(grp, i, j, d) for every pair i < j of a group."""
    a = pool.select("grp", F.col("idx").alias("i"), F.col("x").alias("_a"))
    b = pool.select("grp", F.col("idx").alias("j"), F.col("x").alias("_b"))
    return a.join(b, "grp").where("i < j").select("grp", "i", "j", metric(F.col("_a"), F.col("_b")).alias("d"))


def both_ways(e: DataFrame) -> DataFrame:
    """Each edge in both directions, from one pass over the edges."""
    turned = F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    return e.select("grp", F.inline(F.array(F.struct("i", "j"), turned)), "d")


def medoids(e: DataFrame, digits: int = 9) -> DataFrame:
    """(grp, medoid, total): the member with the least sum of distances; ties (to `digits`) to the lower number."""
    total = both_ways(e).groupBy("grp", "i").agg(F.round(F.sum("d"), digits).alias("total"))
    return total.groupBy("grp").agg(F.min(F.struct("total", "i")).alias("m")).select("grp", F.col("m.i").alias("medoid"), F.col("m.total").alias("total"))


def nearest(e: DataFrame) -> DataFrame:
    """(grp, i, neighbour, d) of every member; ties to the lower number."""
    return both_ways(e).groupBy("grp", "i").agg(F.min(F.struct("d", "j")).alias("m")).select("grp", "i", F.col("m.j").alias("neighbour"), F.col("m.d").alias("d"))


def near_duplicates(e: DataFrame, share: float = 0.02, listed: DataFrame | None = None) -> DataFrame:
    """Pairs within the `share` percentile of their group's positive distances (1e-9 at least). With `listed` (grp, i, j) also those pairs, told by a column."""
    limit = e.groupBy("grp").agg(F.greatest(F.coalesce(F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(share)), F.lit(0.0)), F.lit(1e-9)).alias("limit"))
    out = e.join(limit, "grp")
    if listed is None:
        return out.where(F.col("d") <= F.col("limit"))
    out = out.join(listed.select("grp", "i", "j", F.lit(True).alias("listed")), ["grp", "i", "j"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return out.where((F.col("d") <= F.col("limit")) | F.col("listed"))


def outlier_scores(scaled: DataFrame) -> DataFrame:
    """(grp, member, largest, from_centre, from_medoid, score): greatest |coordinate|, distance to the median vector and to the medoid, both over the group's positive medians (1 where none)."""
    e = edges(scaled)
    centre = _long(scaled).groupBy("grp", "dim").agg(F.percentile("v", F.lit(0.5)).alias("m")).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centre"))
    # each member holds its distances, so the medoid is found and looked up in one pass over the edges
    own = both_ways(e).groupBy("grp", "i").agg(F.round(F.sum("d"), 9).alias("total"), F.map_from_entries(F.collect_list(F.struct("j", "d"))).alias("to"))
    medoid = F.min(F.struct("total", "i")).over(W.partitionBy("grp"))["i"]
    to_medoid = own.select("grp", F.col("i").alias("idx"), F.when(F.col("i") != medoid, F.col("to")[medoid]).alias("to_medoid"))
    g = W.partitionBy("grp")
    positive = lambda c: F.coalesce(F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(0.5)).over(g), F.lit(1.0))
    out = scaled.join(centre, "grp").join(to_medoid, ["grp", "idx"], "left").select("grp", "member", F.aggregate("x", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v))).alias("largest"), euclidean(F.col("x"), F.col("centre")).alias("_c"), F.coalesce("to_medoid", F.lit(0.0)).alias("_m"))
    out = out.withColumn("from_centre", F.col("_c") / positive("_c")).withColumn("from_medoid", F.col("_m") / positive("_m"))
    return out.select("grp", "member", "largest", "from_centre", "from_medoid", (F.col("largest") + F.col("from_centre") + F.col("from_medoid")).alias("score"))


def imbalance_qc(df: DataFrame, group: str, x: str) -> DataFrame:
    """Adds score, flag and priority of |x| against its group: (|x| - median) / max(1.4826 MAD, IQR / 1.349, 0.02); flagged from 3.5, high from 5."""
    g = W.partitionBy(group)
    p = lambda c, q: F.percentile(c, F.lit(q)).over(g)
    out = df.withColumn("_a", F.abs(F.col(x))).withColumn("_m", p("_a", 0.5)).withColumn("_iqr", p("_a", 0.75) - p("_a", 0.25)).withColumn("_d", F.abs(F.col("_a") - F.col("_m")))
    out = out.withColumn("qc_score", (F.col("_a") - F.col("_m")) / F.greatest(F.lit(1.4826) * p("_d", 0.5), F.col("_iqr") / F.lit(1.349), F.lit(0.02)))
    return out.withColumn("qc_flag", F.col("qc_score") >= 3.5).withColumn("qc_priority", F.when(F.col("qc_score") >= 5, "high").when(F.col("qc_score") >= 3.5, "review").otherwise("none")).drop("_a", "_m", "_iqr", "_d")


def explained_variance(df: DataFrame, group: str, vector: str, share: float = 0.95) -> DataFrame:
    """(grp, component, ratio, cumulative, kept) of each group's principal components; a component is kept while the cumulated share before it is below `share`."""

    def pca(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
        x = x[:, x.var(axis=0) > 1e-12]
        most = min(len(x) - 1, x.shape[1])
        if most < 1:
            return pd.DataFrame({"grp": pd.Series(dtype=str), "component": pd.Series(dtype=int), "ratio": pd.Series(dtype=float)})
        s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:most] ** 2
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "component": range(1, most + 1), "ratio": s / s.sum()})

    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(vector).cast("array<double>").alias("x")).where("grp is not null and x is not null")
    got = rows.groupBy("grp").applyInPandas(pca, "grp string, component int, ratio double")
    up_to = F.sum("ratio").over(W.partitionBy("grp").orderBy("component").rowsBetween(W.unboundedPreceding, 0))
    return got.withColumn("cumulative", up_to).withColumn("kept", F.col("cumulative") - F.col("ratio") < share)


def farthest_pool(pool: DataFrame, size: int, duplicates: DataFrame | None = None) -> DataFrame:
    """(grp, member, position): the farthest-point pool of `pools.farthest` on the plain coordinates; `duplicates` (grp, i, j) lists near pairs."""
    return _chosen(pool, duplicates, lambda d, near: pools.farthest(d, size, near))


def greedy_medoids(pool: DataFrame, size: int) -> DataFrame:
    """(grp, member, position): the medoids of `pools.swapped_medoids` on the plain coordinates."""
    return _chosen(pool, None, lambda d, near: pools.swapped_medoids(d, size))


def _chosen(pool: DataFrame, duplicates: DataFrame | None, choose) -> DataFrame:
    rows = pool.select("grp", "member", "idx", "x")
    if duplicates is not None:
        e = both_ways(duplicates.select("grp", "i", "j", "d")).groupBy("grp", F.col("i").alias("idx")).agg(F.array_sort(F.collect_set("j")).alias("near"))
        rows = rows.join(e, ["grp", "idx"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        d = pools.distances(np.array(pdf["x"].tolist(), dtype=float))
        near = np.zeros_like(d, dtype=bool)
        for k, ids in enumerate(pdf["near"] if "near" in pdf else ()):
            if ids is not None:
                near[k, [int(i) - 1 for i in ids]] = True
        at = choose(d, near)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "member": pdf["member"].iloc[at].to_numpy(), "position": range(1, len(at) + 1)})

    return rows.groupBy("grp").applyInPandas(run, "grp string, member string, position int")
