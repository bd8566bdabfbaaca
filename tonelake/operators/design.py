"""Experiment design and simulation: sticky assignment, blocked orders, labels, scenario grids, seeded draws.

Everything random is a hash of keys and a seed, so results do not depend on partitions and can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by the keys and the seed."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 31).cast("bigint")) / F.lit(float(1 << 31))


def normal(*keys: Column, seed: int = 0) -> Column:
    """A standard normal number fixed by the keys and the seed (Box-Muller)."""
    u = F.greatest(uniform(*keys, seed=seed), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * uniform(*keys, seed=seed + 1_000_003))


def assign(df: DataFrame, key: str, groups: list[str], stored: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Adds `assigned`: the stored group if still one of `groups`, else one fixed by the key."""
    fresh = F.element_at(F.array(*(F.lit(g) for g in groups)), (F.floor(uniform(F.col(key), seed=seed) * len(groups)) + 1).cast("int"))
    if stored is None:
        return df.withColumn("assigned", fresh)
    kept = stored.select(key, F.col("assigned").alias("_kept"))
    return df.join(kept, key, "left").withColumn("assigned", F.when(F.col("_kept").isin(groups), F.col("_kept")).otherwise(fresh)).drop("_kept")


def blocked_order(df: DataFrame, unit: str, block: str, item: str, seed: int = 0) -> DataFrame:
    """(unit, block, item, block_position, item_position, label): blocks shuffled per unit, items within blocks, labels A, B, ... by position."""
    blocks = df.select(unit, block).distinct().withColumn("block_position", F.row_number().over(W.partitionBy(unit).orderBy(uniform(F.col(unit), F.col(block), seed=seed), block)))
    items = df.select(unit, block, item).distinct().withColumn("item_position", F.row_number().over(W.partitionBy(unit, block).orderBy(uniform(F.col(unit), F.col(block), F.col(item), seed=seed + 1), item)))
    return items.join(blocks, [unit, block]).withColumn("label", F.char(F.lit(64) + F.col("item_position")))


def scenario_grid(spark: SparkSession, scenarios: dict[str, float], sizes: list[int], repetitions: int) -> DataFrame:
    """(scenario, scale, participants, repetition, run_seed) of every run."""
    s = spark.createDataFrame([(k, float(v), i) for i, (k, v) in enumerate(scenarios.items())], "scenario string, scale double, _i int")
    grid = s.select("*", F.explode(F.array(*(F.lit(n) for n in sizes))).alias("participants")).select("*", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    return grid.select("scenario", "scale", "participants", "repetition", (F.lit(42) + 100_000 * F.col("_i") + 100 * F.col("participants") + F.col("repetition")).alias("run_seed"))


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that no checkpoint holds yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def simulated_ratings(spark: SparkSession, participants: int, items: DataFrame, item: str, effect: str, noise: float, seed: int = 0) -> DataFrame:
    """(participant, item, expected, rating): effect + participant offset + noise, clipped to 0..100 and rounded to one digit."""
    people = spark.range(1, participants + 1).withColumnRenamed("id", "participant")
    rows = people.join(items.select(item, effect))
    offset = 6 * normal(F.col("participant"), seed=seed)
    expected = F.col(effect) + offset
    drawn = expected + noise * normal(F.col("participant"), F.col(item), seed=seed + 7)
    return rows.select("participant", item, expected.alias("expected"), F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), drawn)), 1).alias("rating"))


def group_split(participants: int, odd_first: bool = True) -> tuple[int, int]:
    """Sizes of two groups; the first gets the odd participant, or it is dropped from both counts."""
    return (-(-participants // 2), participants // 2) if odd_first else (participants // 2, participants // 2)


def full_design(spark: SparkSession, participants: int, stimuli: DataFrame, group: str, song: str, item: str, episodes: list[str], seed: int = 0) -> DataFrame:
    """(participant, group, song, episode, item, position): every participant rates all items of its group's songs in every episode, items shuffled per trial.

    Participants are spread over the groups in turn. The stimuli are joined by their group, so a participant meets its own only.
    """
    groups = stimuli.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_g", F.row_number().over(W.orderBy(group)) - 1)  # the few groups of a study
    size = groups.agg(F.count(F.lit(1)).alias("_k"))
    people = spark.range(1, participants + 1).withColumnRenamed("id", "participant").join(F.broadcast(size)).withColumn("_g", F.pmod(F.col("participant") - 1, F.col("_k")).cast("int"))
    mine = people.join(F.broadcast(groups), "_g").select("participant", group)
    rows = mine.join(stimuli.select(group, song, item).distinct(), group).select("*", F.explode(F.array(*(F.lit(e) for e in episodes))).alias("episode"))
    order = W.partitionBy("participant", song, "episode").orderBy(uniform(F.col("participant"), F.col(song), F.col("episode"), F.col(item), seed=seed), item)
    return rows.select("participant", group, song, "episode", item, F.row_number().over(order).alias("position"))
