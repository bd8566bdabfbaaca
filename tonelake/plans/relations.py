"""Queries of the smaller relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import preferences, relations, vectors
from tonelake.plans.ratings import SCALARS, rounded
from tonelake.plans.vectors import _POOL, _SCALED
from tonelake.sources.tables import table

WEIGHTS = {"rms_mean": 0.8, "crest_factor_mean": -0.5, "stereo_width": 0.3, "stereo_imbalance": -1.1}


def latest_evaluations(spark: SparkSession, d: str) -> DataFrame:
    return relations.latest(table(spark, d, "evaluations"), "evaluation_id", ["received_at"], ["participant_id", "mix_id", "received_at"])


def response_durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "responses_long").select("response_row_id", relations.duration_ms(F.col("started_at"), F.col("completed_at")).alias("duration_ms"))


def disjunctive_match(spark: SparkSession, d: str) -> DataFrame:
    """Responses matched to a configured excerpt by stimulus, else by mix, else by path."""
    rows = table(spark, d, "responses_long").select("response_row_id", F.col("stimulus_id").alias("by_stimulus"), F.col("actual_mix_id").alias("by_mix"), F.col("audio_path").alias("by_path"))
    return relations.match_any(rows, table(spark, d, "stimuli"), [("by_stimulus", "stimulus_id"), ("by_mix", "mix_id"), ("by_path", "audio_path")], "excerpt_id").select("response_row_id", "matched", "matched_by")


def _mixes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "selection_method_comparison").where("excerpt_id is not null and mix_ids is not null")
    return s.select("selection_id", "excerpt_id", "method", F.array_distinct(F.transform(F.split("mix_ids", r"\|"), lambda x: F.trim(x))).alias("mixes"))


def selection_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each selection against the first one of its excerpt."""
    s = _mixes(spark, d)
    first = s.groupBy("excerpt_id").agg(F.min_by("mixes", "selection_id").alias("primary"))
    got = s.join(first, "excerpt_id")
    return rounded(got.select("selection_id", *(c.alias(n) for n, c in relations.set_overlap(F.col("mixes"), F.col("primary")).items())))


def method_inclusion(spark: SparkSession, d: str) -> DataFrame:
    long = _mixes(spark, d).where("method is not null").select("excerpt_id", "method", F.explode("mixes").alias("mix_id"))
    return rounded(relations.inclusion(long, "excerpt_id", "mix_id", "method"))


def linear_predictor(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "features").select("feature_row_id", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in WEIGHTS))
    return rounded(relations.linear_predictor(f, "feature_row_id", WEIGHTS, 50.0))


def band_contrast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "features").where("size(bark) = 48").select("feature_row_id", relations.band_contrast(F.col("bark"), (1, 12), (13, 12)).alias("contrast")))


def mixdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.mixdown(table(spark, d, "features").where("excerpt_id is not null"), "excerpt_id", "bark"))


def top_contributions(spark: SparkSession, d: str) -> DataFrame:
    pool = vectors.members(table(spark, d, "features"), "excerpt_id", "mix_id", "feature_row_id", SCALARS)
    return relations.top_contributions(vectors.robust_scale(pool), SCALARS)


def closest_means(spark: SparkSession, d: str) -> DataFrame:
    """The two mixes of each song with the nearest mean preferences."""
    m = table(spark, d, "evaluations").where("preference_score_0_1 between 0 and 1 and mix_id is not null and song_id is not null").groupBy("song_id", "mix_id").agg(F.round(F.avg("preference_score_0_1"), 9).alias("mean"))
    return rounded(relations.closest_values(m, "song_id", "mix_id", "mean"))


def strongest_correlations(spark: SparkSession, d: str) -> DataFrame:
    """The twelve strongest correlations of feature columns, one per magnitude."""
    f = table(spark, d, "features")
    p = preferences.pearson_pairs(f, SCALARS).where("r is not null").withColumn("size", F.round(F.abs("r"), 9))
    one = p.groupBy("size").agg(F.min(F.struct("x", "y", "r")).alias("b")).orderBy(F.desc("size")).limit(12)
    return rounded(one.select("b.x", "b.y", "b.r"))


def variance_inflation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.variance_inflation(table(spark, d, "features"), ["rms_mean", "crest_factor_mean", "stereo_width", "stereo_imbalance"]))


QUERIES = {f.__name__: f for f in (latest_evaluations, response_durations, disjunctive_match, selection_overlap, method_inclusion, linear_predictor, band_contrast, mixdown, top_contributions, closest_means, strongest_correlations, variance_inflation)}

_r = lambda e, n: f"round({e} + 1e-10, 6) + 0.0 AS {n}"
_SETS = "s AS (SELECT selection_id, excerpt_id, method, list_distinct(list_transform(string_split(mix_ids, '|'), lambda x: trim(x, ' '))) AS mixes FROM selection_method_comparison WHERE excerpt_id IS NOT NULL AND mix_ids IS NOT NULL)"
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM features WHERE isfinite({a}) AND isfinite({b})" for i, a in enumerate(SCALARS) for b in SCALARS[i + 1 :])

_VIF = ["rms_mean", "crest_factor_mean", "stereo_width", "stereo_imbalance"]
# the inverse of a correlation matrix of four columns has minors of three over the determinant on its diagonal
_R = ", ".join(f"corr({_VIF[i]}, {_VIF[j]}) AS {n}" for n, (i, j) in zip("abcdef", ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))))
_DET = "1 - a*a - b*b - c*c - d*d - e*e - f*f + 2*a*b*d + 2*a*c*e + 2*b*c*f + 2*d*e*f + a*a*f*f + b*b*e*e + c*c*d*d - 2*a*b*e*f - 2*a*c*d*f - 2*b*c*d*e"

SQL = {
    "variance_inflation": f"WITH r AS (SELECT {_R} FROM features WHERE {' AND '.join(f'isfinite({c})' for c in _VIF)}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round((1 + 2*{x}*{y}*{z} - {x}*{x} - {y}*{y} - {z}*{z}) / ({_DET}) + 1e-10, 6) + 0.0 AS vif FROM r" for c, (x, y, z) in zip(_VIF, ("def", "bcf", "ace", "abd"))),
    "latest_evaluations": "SELECT evaluation_id, participant_id, mix_id, received_at FROM evaluations WHERE evaluation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evaluation_id ORDER BY received_at DESC NULLS LAST, participant_id DESC NULLS LAST, mix_id DESC NULLS LAST) = 1",
    "response_durations": "SELECT response_row_id, CASE WHEN epoch_ms(completed_at) >= epoch_ms(started_at) THEN epoch_ms(completed_at) - epoch_ms(started_at) END AS duration_ms FROM responses_long",
    "disjunctive_match": """WITH a AS (SELECT stimulus_id AS k, min(excerpt_id) AS v FROM stimuli GROUP BY 1), b AS (SELECT mix_id AS k, min(excerpt_id) AS v FROM stimuli GROUP BY 1), c AS (SELECT audio_path AS k, min(excerpt_id) AS v FROM stimuli GROUP BY 1)
      SELECT response_row_id, coalesce(a.v, b.v, c.v) AS matched, CASE WHEN a.v IS NOT NULL THEN 'by_stimulus' WHEN b.v IS NOT NULL THEN 'by_mix' WHEN c.v IS NOT NULL THEN 'by_path' END AS matched_by
      FROM responses_long r LEFT JOIN a ON a.k = r.stimulus_id LEFT JOIN b ON b.k = r.actual_mix_id LEFT JOIN c ON c.k = r.audio_path""",
    "selection_overlap": f"""WITH {_SETS}, p AS (SELECT excerpt_id, arg_min(mixes, selection_id) AS prime FROM s GROUP BY 1), j AS (SELECT *, list_intersect(mixes, prime) AS common FROM s JOIN p USING (excerpt_id))
      SELECT selection_id, array_to_string(list_sort(common), '|') AS shared, len(common)::INTEGER AS overlap, len(list_distinct(list_concat(mixes, prime)))::INTEGER AS union_size, {_r('CASE WHEN len(mixes) > 0 THEN len(common) / len(mixes) END', 'stability')} FROM j""",
    "method_inclusion": f"""WITH {_SETS}, l AS (SELECT excerpt_id, method, unnest(mixes) AS mix_id FROM s WHERE method IS NOT NULL), o AS (SELECT excerpt_id, count(DISTINCT method) AS k FROM l GROUP BY 1)
      SELECT excerpt_id, mix_id, count(DISTINCT method) AS methods, {_r('count(DISTINCT method) / any_value(k)', 'share')} FROM l JOIN o USING (excerpt_id) GROUP BY 1, 2""",
    "linear_predictor": "SELECT feature_row_id, " + _r("CASE WHEN " + " AND ".join(f"NOT isnan({c})" for c in WEIGHTS) + " THEN 50 + " + " + ".join(f"({w}) * {c}" for c, w in WEIGHTS.items()) + " END", "eta") + " FROM features",
    "band_contrast": f"SELECT feature_row_id, {_r('list_sum(bark[13:24]) / 12 - list_sum(bark[1:12]) / 12', 'contrast')} FROM features WHERE len(bark) = 48",
    "mixdown": f"SELECT excerpt_id, pos, {_r('sum(v)', 'level')} FROM (SELECT excerpt_id, unnest(range(len(bark)))::INTEGER AS pos, unnest(bark) AS v FROM features WHERE excerpt_id IS NOT NULL) GROUP BY 1, 2",
    "top_contributions": f"""WITH {_POOL}, {_SCALED}, k AS (SELECT *, row_number() OVER (PARTITION BY grp, member ORDER BY round(abs(v), 9) DESC, dim) AS rn FROM scaled)
      SELECT grp, member, string_agg([{', '.join(f"'{c}'" for c in SCALARS)}][dim + 1] || CASE WHEN v < 0 THEN '-' ELSE '+' END, ', ' ORDER BY rn) AS contributions FROM k WHERE rn <= 2 GROUP BY 1, 2""",
    "closest_means": f"""WITH m AS (SELECT song_id, mix_id, round(avg(preference_score_0_1), 9) AS v FROM evaluations WHERE preference_score_0_1 BETWEEN 0 AND 1 AND mix_id IS NOT NULL AND song_id IS NOT NULL GROUP BY 1, 2),
      g AS (SELECT song_id, lag(mix_id) OVER w AS a, mix_id AS b, round(v - lag(v) OVER w, 12) AS gap, v FROM m WINDOW w AS (PARTITION BY song_id ORDER BY v, mix_id)), k AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY gap, v, a, b) AS rn FROM g WHERE gap IS NOT NULL)
      SELECT song_id, a AS first, b AS second, {_r('gap', 'gap')} FROM k WHERE rn = 1""",
    "strongest_correlations": f"WITH p AS ({_CORR}), o AS (SELECT *, row_number() OVER (PARTITION BY round(abs(r), 9) ORDER BY x, y, r) AS rn FROM p) SELECT x, y, {_r('o.r', 'r')} FROM o WHERE rn = 1 ORDER BY round(abs(o.r), 9) DESC LIMIT 12",
}
