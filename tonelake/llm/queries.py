"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import abuse, consensus, leakage, quantiles, subset, tokens
from tonelake.llm.sql import SQL  # noqa: F401  (read by the entry module)
from tonelake.sources.tables import cut, table

SCALARS = ["rms_left", "rms_right", "rms_mean", "crest_factor_left", "crest_factor_right", "crest_factor_mean", "stereo_width", "stereo_imbalance"]
KIND_RADIUS = 1.0
SUBSET_SIZE = 6

PREFERENCE, PERCENTILE = "median_previous_preference", "rating_percentile_within_song"
PROPOSAL_GROUPS = ["song_id", "rating_condition", "review_round"]

#: Participants with so many labels are found if the messages doubt them and their correlation with the others' means is below the limit.
LEAST_LABELS, UNRELATED, DOUBTFUL = 40, 0.4, 0.6


def _edges(spark: SparkSession, d: str) -> DataFrame:
    labels = consensus.distinct_labels(table(spark, d, "evaluations"), "evaluation_id", "participant_id", "mix_id", "preference_score_0_1", "received_at")
    return cut(consensus.label_edges(cut(labels)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Participants whom the messages doubt, confirmed by their exact correlation with the others' means."""
    return consensus.unrelated(_edges(spark, d), LEAST_LABELS, UNRELATED, DOUBTFUL).select(F.col("annotator").alias("participant_id"))


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    items, _ = consensus.pass_messages(_edges(spark, d))
    return consensus.consensus(items).select(F.col("item").alias("mix_id"), "labels", "label", F.round("agreement", 6).alias("agreement"))


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    _, annotators = consensus.pass_messages(edges)
    return annotators.join(consensus.others_correlation(edges), "annotator", "left").select(F.col("annotator").alias("participant_id"), "labels", F.round("reliability", 4).alias("reliability"), F.round("correlation", 6).alias("correlation"), "converged")


def _pools(spark: SparkSession, d: str) -> DataFrame:
    return subset.pools(table(spark, d, "features"), "excerpt_id", "mix_id", "feature_row_id", SCALARS, ["institution_code"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    chosen = subset.selected_members(table(spark, d, "selection_method_comparison"), "selection_id", "excerpt_id", "mix_ids")
    return subset.crowded_selections(_pools(spark, d), chosen, KIND_RADIUS).select(F.col("selection").alias("selection_id"))


def p3_subsets(spark: SparkSession, d: str) -> DataFrame:
    """A varied subset of each excerpt's pool, reported like the earlier selections."""
    return subset.subset_report(_pools(spark, d), SUBSET_SIZE, "institution_code").select(
        F.col("grp").alias("excerpt_id"), "subset_size", "mix_ids", F.round("minimum_pairwise_distance", 6).alias("minimum_pairwise_distance"), F.round("mean_pairwise_distance", 6).alias("mean_pairwise_distance"), "unique_institution_count"
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = quantiles.percentiles(table(spark, d, "six_mix_proposals"), ["review_round"], [PREFERENCE, PERCENTILE], [0.5, 0.95], 0.0, 1.0)
    high = ((F.col("measure") == PREFERENCE) & (F.col("p") == 0.95) & (F.col("value") >= 0.80)) | ((F.col("measure") == PERCENTILE) & (F.col("p") == 0.5) & (F.col("value") >= 0.60))
    return rows.where(high & F.col("review_round").isNotNull()).select("review_round", "measure")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(table(spark, d, "six_mix_proposals"), PROPOSAL_GROUPS, [PREFERENCE, PERCENTILE], [0.05, 0.25, 0.5, 0.75, 0.95], 0.0, 1.0)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_consensus, p2_reliability, p3_found, p3_subsets, p5_found, p5_percentiles, p7_ids)}


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_items"), "item_id", "item_text").select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items: in how many documents each shows, word for word or with changes."""
    found = leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_items"), "item_id", "item_text")
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "loose").alias("loose"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), "doc_id", "text").where(F.col("score") >= abuse.FLAG).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents and abusive documents per source."""
    got = abuse.scores(table(spark, d, "documents"), "doc_id", "text", ["source"])
    flagged = F.count_if(F.col("score") >= abuse.FLAG)
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), flagged.alias("abusive"), F.round(flagged / F.count(F.lit(1)), 6).alias("rate"))


QUERIES |= {f.__name__: f for f in (p8_found, p8_items, p9_found, p9_rates)}
