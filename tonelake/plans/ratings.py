"""Queries of inventories and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import stats
from tonelake.functions.numeric import is_finite
from tonelake.operators import inventory, ratings
from tonelake.sources.records import label_ok, rating_ok
from tonelake.sources.tables import table

SCALARS = ["rms_left", "rms_right", "rms_mean", "crest_factor_left", "crest_factor_right", "crest_factor_mean", "stereo_width", "stereo_imbalance"]
PROFILED = ["song_id", "mix_id", "participant_id", "evaluator_institution_code", "year", "presented_id", "has_comment", "listened_flag"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show; the shift keeps exact halves on one side."""
    return df.select(*((F.round(F.col(c) + F.lit(1e-10), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def inventory_join_status(spark: SparkSession, d: str) -> DataFrame:
    songs = inventory.last_wins(table(spark, d, "songs").where("song_id is not null").withColumn("seq", F.coalesce("added_at", F.to_timestamp_ntz(F.lit("1970-01-01")))), ["song_id"], ["artist"], "seq").select("song_id", "artist")
    mixes = table(spark, d, "stimuli").where("mix_id is not null").groupBy("mix_id").agg(F.min("excerpt_id").alias("excerpt_id"))
    facts = table(spark, d, "responses_long").select("response_row_id", F.col("song_id").alias("ref_song"), "actual_mix_id")
    return inventory.join_status(facts, {"song": (songs.select("song_id"), "ref_song", "song_id"), "mix": (mixes, "actual_mix_id", "mix_id")}).select("response_row_id", "excerpt_id", "join_status")


def _response_rules() -> dict:
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return {
        "missing_study_id": blank("study_id"), "missing_song_id": blank("song_id"), "missing_stimulus_id": blank("stimulus_id"), "rating_not_integer_0_100": ~rating_ok(F.col("rating")), "invalid_label": ~label_ok(F.col("display_label")),
        "never_played": ~F.col("audio_played"), "not_completed": F.col("completed_at").isNull(), "ends_before_start": F.col("completed_at") < F.col("started_at"), "no_response_time": F.col("response_time_ms").isNull() | (F.col("response_time_ms") < 0),
    }


def validity_reasons(spark: SparkSession, d: str) -> DataFrame:
    return inventory.with_reasons(table(spark, d, "responses_long"), _response_rules()).select("response_row_id", "reasons", "valid")


def first_reason_wins(spark: SparkSession, d: str) -> DataFrame:
    return inventory.with_first_reason(table(spark, d, "responses_long"), _response_rules()).select("response_row_id", "reason")


def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.trim("text") != "", F.sha2("text", 256)).alias("text_hash"))
    return inventory.with_copies(docs, "text_hash").select("doc_id", "text_hash", "copies", "is_duplicate")


def group_rollup_ranked(spark: SparkSession, d: str) -> DataFrame:
    got = inventory.rollup(table(spark, d, "evaluations"), "song_id", F.coalesce(F.col("has_comment") == "yes", F.lit(False)), "evaluator_institution_code", "listen_duration_seconds")
    return rounded(inventory.ranked_where(got, F.col("code_count") >= 3, [F.desc("flagged"), F.desc("rows"), F.asc_nulls_first("song_id")]))


def mapping_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return inventory.last_wins(table(spark, d, "features").where("mix_id is not null"), ["song_id", "mix_id"], ["original_mix_name", "institution_code"], "feature_row_id")


def table_diff(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    before = s.where("s_suppkey % 7 <> 0")
    after = s.where("s_suppkey % 11 <> 0").withColumn("s_acctbal", F.when(F.col("s_nationkey") == 3, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return inventory.table_diff(before, after, "s_suppkey")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return ratings.rating_summary(table(spark, d, "evaluations").where("mix_id is not null"), "mix_id", "preference_score_0_1", "participant_id", "evaluator_institution_code")


def rating_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_summary(spark, d))


def rating_summary_by_part(spark: SparkSession, d: str) -> DataFrame:
    """The same summary on the largest star-schema table: quantity by part."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_suppkey", "l_returnflag")
    return rounded(ratings.rating_summary(lines, "l_partkey", "l_quantity", "l_suppkey", "l_returnflag"))


def rating_summary_keeps_unrated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ratings.keep_unrated(table(spark, d, "stimuli"), "mix_id", _summary(spark, d)).select("mix_id", "n", "mean", "median", "status"))


def _by_song(spark: SparkSession, d: str) -> DataFrame:
    songs = table(spark, d, "evaluations").where("mix_id is not null").groupBy("mix_id").agg(F.max("song_id").alias("song_id"))
    return _summary(spark, d).join(songs, "mix_id")


def within_group_descriptors(spark: SparkSession, d: str) -> DataFrame:
    got = ratings.within_group(_by_song(spark, d).where("mean is not null"), "song_id", "mean", "se", "n")
    return rounded(got.select("song_id", "mix_id", "mean", "rank", "pct", "centred", "z", "robust_z", "weight"))


def coverage_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ratings.coverage(_by_song(spark, d), "song_id"))


def context_summary(spark: SparkSession, d: str) -> DataFrame:
    contexts = {"experiment": F.col("experiment_id"), "institution": F.col("evaluator_institution_code"), "year": F.coalesce(F.col("year").cast("string"), F.lit("unknown"))}
    return rounded(ratings.context_summary(table(spark, d, "evaluations"), contexts, "preference_score_0_1"))


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return ratings.column_profile(table(spark, d, "evaluations"), PROFILED)


def low_count_warnings(spark: SparkSession, d: str) -> DataFrame:
    rules = {"unrated": F.col("n") == 0, "low_count": (F.col("n") > 0) & (F.col("n") < 5), "ci_unavailable": F.col("ci_method") == "unavailable", "single_institution": F.col("institution_count") <= 1}
    return inventory.with_reasons(_summary(spark, d), rules).where(~F.col("valid")).select("mix_id", "n", "reasons")


def feature_summary_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ratings.feature_summary(table(spark, d, "features"), "song_id", SCALARS))


def band_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ratings.band_summary(table(spark, d, "features"), "song_id", "bark"))


def zscore_population(spark: SparkSession, d: str) -> DataFrame:
    """Population z-scores over a whole column: its two moments first, then one narrow pass."""
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    m = part.agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"))
    return rounded(part.join(F.broadcast(m)).select("p_partkey", F.when(F.col("s") > 1e-12, (F.col("p_retailprice") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z")))


QUERIES = {f.__name__: f for f in (
    inventory_join_status, validity_reasons, first_reason_wins, duplicate_flags, group_rollup_ranked, mapping_last_wins, table_diff, rating_summary, rating_summary_by_part, rating_summary_keeps_unrated,
    within_group_descriptors, coverage_by_group, context_summary, column_profile, low_count_warnings, feature_summary_long, band_summary, zscore_population)}

_FIN = "isfinite({0}::DOUBLE)"
_T = "[" + ", ".join(map(repr, stats.t_table())) + "]"
_Z = stats.Z975
_SERIES = f"({_Z} + {(_Z**3 + _Z) / 4!r} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / (df * df) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / (df * df * df))"


def summary_sql(source: str, item: str, score: str, rater: str, institution: str) -> str:
    x = f"CASE WHEN isfinite({score}::DOUBLE) THEN {score}::DOUBLE END"
    return f"""
base AS (SELECT {item}, {x} AS x, {rater} AS rater, CASE WHEN trim({institution}) <> '' THEN {institution} END AS inst FROM {source}),
agg AS (SELECT {item}, count(x) AS n, count(*) - count(x) AS missing, count(DISTINCT rater)::INTEGER AS raters, count(DISTINCT inst)::INTEGER AS institution_count,
        coalesce(string_agg(DISTINCT inst, '|' ORDER BY inst), '') AS institutions, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS sd, var_samp(x) AS variance,
        quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, min(x) AS least, max(x) AS greatest FROM base GROUP BY 1),
tee AS (SELECT *, CASE WHEN n > 1 THEN sd / sqrt(n) END AS se, (n - 1)::DOUBLE AS df FROM agg),
half AS (SELECT *, se * CASE WHEN df > {stats.TABLE_DF} THEN {_SERIES} WHEN df >= 1 THEN list_extract({_T}, df::INTEGER) END AS h FROM tee),
summary AS (SELECT {item}, n, missing, raters, institution_count, institutions, mean, median, CASE WHEN n > 1 THEN sd END AS sd, CASE WHEN n > 1 THEN variance END AS variance, se, q25, q75, q75 - q25 AS iqr,
        least, greatest, greatest - least AS span, CASE WHEN n > 1 THEN mean - h END AS ci_low, CASE WHEN n > 1 THEN mean + h END AS ci_high,
        CASE WHEN n > 1 THEN 'student_t' ELSE 'unavailable' END AS ci_method, n > 0 AND n < 5 AS low_count, CASE WHEN n = 0 THEN 'unrated' WHEN n < 5 THEN 'low_count' ELSE 'ok' END AS status FROM half)"""


_ROUNDED = "mean median sd variance se q25 q75 iqr least greatest span ci_low ci_high".split()
_REST = "n missing raters institution_count institutions ci_method low_count status".split()
_SUMMARY = summary_sql("(SELECT * FROM evaluations WHERE mix_id IS NOT NULL)", "mix_id", "preference_score_0_1", "participant_id", "evaluator_institution_code")
_SONGS = "song_of AS (SELECT mix_id, max(song_id) AS song_id FROM evaluations WHERE mix_id IS NOT NULL GROUP BY 1), bysong AS (SELECT s.*, o.song_id FROM summary s JOIN song_of o USING (mix_id))"


def _cols(*names: str) -> str:
    return ", ".join(f"round({c} + 1e-10, 6) + 0.0 AS {c}" if c in _ROUNDED else c for c in names)


_BAD_RATING = "NOT coalesce(regexp_full_match(trim(rating, ' ' || chr(9)), '[0-9]{1,2}|0[0-9]{2}|100'), false)"
_BAD_LABEL = "NOT coalesce(regexp_full_match(regexp_replace(trim(display_label, ' ' || chr(9)), '^(?i:version)[ \\t]+', ''), '[A-F]'), false)"
_RULES = [
    ("missing_study_id", "coalesce(trim(study_id), '') = ''"), ("missing_song_id", "coalesce(trim(song_id), '') = ''"), ("missing_stimulus_id", "coalesce(trim(stimulus_id), '') = ''"), ("rating_not_integer_0_100", _BAD_RATING), ("invalid_label", _BAD_LABEL),
    ("never_played", "NOT audio_played"), ("not_completed", "completed_at IS NULL"), ("ends_before_start", "completed_at < started_at"), ("no_response_time", "response_time_ms IS NULL OR response_time_ms < 0"),
]
_REASONS = "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES) + ")"


def _described(source: str, group: str, part: str) -> str:
    r = lambda e, n: f"round({e} + 1e-10, 6) + 0.0 AS {n}"
    return f"""SELECT {group}, {part}, count(x) AS n, {r('avg(x)', 'mean')}, {r('coalesce(stddev_samp(x), 0)', 'sd')}, {r('min(x)', 'least')}, {r('quantile_cont(x, 0.25)', 'q25')}, {r('median(x)', 'median')}, {r('quantile_cont(x, 0.75)', 'q75')},
      {r('max(x)', 'greatest')}, {r('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 'iqr')}, {r('CASE WHEN abs(avg(x)) > 1e-12 THEN coalesce(stddev_samp(x), 0) / abs(avg(x)) END', 'cov')}
      FROM ({source}) WHERE isfinite(x) GROUP BY 1, 2"""


SQL = {
    "inventory_join_status": """SELECT r.response_row_id, m.excerpt_id,
      CASE WHEN s.song_id IS NULL AND m.mix_id IS NULL THEN 'missing_song_and_mix' WHEN s.song_id IS NULL THEN 'missing_song' WHEN m.mix_id IS NULL THEN 'missing_mix' ELSE 'matched' END AS join_status
      FROM responses_long r LEFT JOIN (SELECT DISTINCT song_id FROM songs WHERE song_id IS NOT NULL) s ON r.song_id = s.song_id
      LEFT JOIN (SELECT mix_id, min(excerpt_id) AS excerpt_id FROM stimuli WHERE mix_id IS NOT NULL GROUP BY 1) m ON r.actual_mix_id = m.mix_id""",
    "validity_reasons": f"SELECT response_row_id, {_REASONS} AS reasons, {_REASONS} = '' AS valid FROM responses_long",
    "first_reason_wins": "SELECT response_row_id, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _RULES) + " END AS reason FROM responses_long",
    "duplicate_flags": """WITH h AS (SELECT doc_id, CASE WHEN trim(text, ' ') <> '' THEN sha256(text) END AS text_hash FROM documents)
      SELECT doc_id, text_hash, CASE WHEN text_hash IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY text_hash) END AS copies, text_hash IS NOT NULL AND count(*) OVER (PARTITION BY text_hash) > 1 AS is_duplicate FROM h""",
    "group_rollup_ranked": """WITH g AS (SELECT song_id, count(*) AS rows, count(*) FILTER (WHERE has_comment = 'yes') AS flagged,
        count(DISTINCT CASE WHEN trim(evaluator_institution_code) <> '' THEN evaluator_institution_code END)::INTEGER AS code_count,
        coalesce(string_agg(DISTINCT CASE WHEN trim(evaluator_institution_code) <> '' THEN evaluator_institution_code END, '|' ORDER BY CASE WHEN trim(evaluator_institution_code) <> '' THEN evaluator_institution_code END), '') AS codes,
        round(min(listen_duration_seconds) + 1e-10, 6) + 0.0 AS least, round(max(listen_duration_seconds) + 1e-10, 6) + 0.0 AS greatest, round(max(listen_duration_seconds) - min(listen_duration_seconds) + 1e-10, 6) + 0.0 AS span FROM evaluations GROUP BY 1)
      SELECT *, CASE WHEN code_count >= 3 THEN sum((code_count >= 3)::INT) OVER (ORDER BY flagged DESC, rows DESC, song_id NULLS FIRST ROWS UNBOUNDED PRECEDING) END::BIGINT AS rank FROM g""",
    "mapping_last_wins": "SELECT song_id, mix_id, arg_max(struct_pack(v := original_mix_name), feature_row_id).v AS original_mix_name, arg_max(struct_pack(v := institution_code), feature_row_id).v AS institution_code, max(feature_row_id) AS feature_row_id FROM features WHERE mix_id IS NOT NULL GROUP BY 1, 2",
    "table_diff": """WITH b AS (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0), a AS (SELECT * REPLACE (CASE WHEN s_nationkey = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal) FROM supplier WHERE s_suppkey % 11 <> 0)
      SELECT s_suppkey, CASE WHEN b.s_name IS NULL THEN 'added' WHEN a.s_name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (s_suppkey)
      WHERE b.s_name IS NULL OR a.s_name IS NULL OR (b.s_name, b.s_nationkey, b.s_acctbal) IS DISTINCT FROM (a.s_name, a.s_nationkey, a.s_acctbal)""",
    "rating_summary": f"WITH {_SUMMARY} SELECT {_cols('mix_id', *_REST, *_ROUNDED)} FROM summary",
    "rating_summary_by_part": f"WITH {summary_sql('lineitem', 'l_partkey', 'l_quantity', 'l_suppkey', 'l_returnflag')} SELECT {_cols('l_partkey', *_REST, *_ROUNDED)} FROM summary",
    "rating_summary_keeps_unrated": f"WITH {_SUMMARY} SELECT mix_id, coalesce(n, 0) AS n, {_cols('mean', 'median')}, coalesce(status, 'unrated') AS status FROM (SELECT DISTINCT mix_id FROM stimuli WHERE mix_id IS NOT NULL) i LEFT JOIN summary s USING (mix_id)",
    "within_group_descriptors": f"""WITH {_SUMMARY}, {_SONGS},
      a AS (SELECT *, rank() OVER (PARTITION BY song_id ORDER BY mean) + (count(*) OVER (PARTITION BY song_id, mean) - 1) / 2.0 AS rk, count(*) OVER g AS k, avg(mean) OVER g AS m, stddev_samp(mean) OVER g AS s, median(mean) OVER g AS med,
            CASE WHEN se > 0 THEN 1 / se ELSE n / max(n) OVER g END AS raw FROM bysong WHERE mean IS NOT NULL WINDOW g AS (PARTITION BY song_id)),
      b AS (SELECT *, median(abs(mean - med)) OVER (PARTITION BY song_id) AS mad, max(raw) OVER (PARTITION BY song_id) AS top FROM a)
      SELECT song_id, mix_id, round(mean + 1e-10, 6) + 0.0 AS mean, round(rk + 1e-10, 6) + 0.0 AS rank, round(rk / k + 1e-10, 6) + 0.0 AS pct, round(mean - m + 1e-10, 6) + 0.0 AS centred, round(CASE WHEN s > 0 THEN (mean - m) / s END + 1e-10, 6) + 0.0 AS z,
             round(CASE WHEN mad > 0 THEN (mean - med) / (1.4826 * mad) END + 1e-10, 6) + 0.0 AS robust_z, round(CASE WHEN top > 0 THEN raw / top END + 1e-10, 6) + 0.0 AS weight FROM b""",
    "coverage_by_group": f"""WITH {_SUMMARY}, {_SONGS} SELECT song_id, count(*) AS items, count(*) FILTER (WHERE n > 0) AS rated, sum(n)::BIGINT AS ratings, min(n) AS least_count, round(median(n) + 1e-10, 6) + 0.0 AS median_count, max(n) AS greatest_count,
      count(*) FILTER (WHERE n < 5) AS below FROM bysong GROUP BY 1""",
    "context_summary": " UNION ALL ".join(
        f"SELECT '{name}' AS context, {c} AS value, count(*) AS rows, count(x) AS scores, round(avg(x) + 1e-10, 6) + 0.0 AS mean FROM (SELECT *, CASE WHEN isfinite(preference_score_0_1) THEN preference_score_0_1 END AS x FROM evaluations) GROUP BY 2"
        for name, c in (("experiment", "experiment_id"), ("institution", "evaluator_institution_code"), ("year", "coalesce(year::VARCHAR, 'unknown')"))
    ),
    "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS present, count(*) - count({c}) AS absent, count(DISTINCT {c}) + (count(*) > count({c}))::INT AS distinct_values, min({c}::VARCHAR) AS least, max({c}::VARCHAR) AS greatest FROM evaluations" for c in PROFILED),
    "low_count_warnings": f"""WITH {_SUMMARY}, w AS (SELECT mix_id, n, concat_ws(';', CASE WHEN n = 0 THEN 'unrated' END, CASE WHEN n > 0 AND n < 5 THEN 'low_count' END, CASE WHEN ci_method = 'unavailable' THEN 'ci_unavailable' END, CASE WHEN institution_count <= 1 THEN 'single_institution' END) AS reasons FROM summary)
      SELECT * FROM w WHERE reasons <> ''""",
    "feature_summary_long": _described(" UNION ALL ".join(f"SELECT song_id, '{c}' AS feature, {c} AS x FROM features" for c in SCALARS), "song_id", "feature"),
    "band_summary": _described("SELECT song_id, (unnest(range(len(bark))))::INTEGER AS band, unnest(bark) AS x FROM features", "song_id", "band"),
    "zscore_population": "SELECT p_partkey, round(CASE WHEN s > 1e-12 THEN (p_retailprice - m) / s ELSE 0 END + 1e-10, 6) + 0.0 AS z FROM part, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part)",
}
