"""Queries of further summaries, draws of models, names and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import numeric, text
from tonelake.operators import excerpts, preferences, summaries
from tonelake.plans.ratings import SCALARS, _by_song, rounded
from tonelake.sources.tables import table

SCORE = "preference_score_0_1"


def rating_context(spark: SparkSession, d: str) -> DataFrame:
    """Sessions, experiments and participants per mix, counted, and years and institutions, listed."""
    return summaries.context_counts(table(spark, d, "evaluations").where("mix_id is not null"), "mix_id", {"sessions": "session_id", "experiments": "experiment_id", "participants": "participant_id"}, {"years": "year", "institutions": "evaluator_institution_code"})


def coverage_with_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "stimuli").select("mix_id").where("mix_id is not null")
    return rounded(summaries.pool_coverage(_by_song(spark, d), pool, "song_id", "mix_id", 100))


def column_examples(spark: SparkSession, d: str) -> DataFrame:
    return summaries.first_examples(table(spark, d, "six_mix_proposals"), ["review_round", "song_id", "rating_condition", "institution_code", "alignment_status", "notes"], "proposal_row_id")


def numeric_ranges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.numeric_ranges(table(spark, d, "six_mix_proposals"), ["mean_previous_preference", "rating_count", "acoustic_pool_rank", "stereo_imbalance", "nearest_neighbour_distance"]))


def rating_integration_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ratings hold what their integration expects."""
    e = table(spark, d, "evaluations")
    s = F.col(SCORE)
    return summaries.check_table(e, {
        "rows_with_participant": (F.count_if(F.col("participant_id").isNotNull()), F.count(F.lit(1))), "rows_with_mix": (F.count_if(F.col("mix_id").isNotNull()), F.count(F.lit(1))),
        "scores_within_0_1": (F.count_if(~s.between(0, 1)), 0), "distinct_evaluations": (F.count_distinct("evaluation_id"), F.count("evaluation_id")), "missing_scores": (F.count_if(s.isNull()), 0),
        "evaluated_before_received": (F.count_if(F.col("evaluated_at") > F.col("received_at")), 0),
    })


def described_columns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.described(table(spark, d, "features"), SCALARS))


def simulation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of four measures six statistics each, and rates and sums of two flags, per return flag and line status."""
    lines = table(spark, d, "lineitem")
    return rounded(summaries.simulation_summary(lines, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], {"large": F.col("l_quantity") > 40, "discounted": F.col("l_discount") > 0.05}), 4)


def filtered_maximum(spark: SparkSession, d: str) -> DataFrame:
    """Per song the greatest rating count of the retained proposals, and of all."""
    p = table(spark, d, "six_mix_proposals").where("song_id is not null")
    kept = F.coalesce((F.col("alignment_status") == "PASS") & (F.col("technical_qc_status") == "PASS"), F.lit(False))
    return p.groupBy("song_id").agg(F.max(F.when(kept, F.col("rating_count"))).alias("retained_greatest"), F.max("rating_count").alias("greatest"), F.count_if(kept).alias("retained"))


def tight_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of scalars that tell something of each other within a song (a check takes 0.98; invented features rarely reach half of that)."""
    f = table(spark, d, "features").where("song_id is not null").select("song_id", *(numeric.finite(F.col(c)).alias(c) for c in SCALARS))
    return rounded(preferences.pearson_pairs(f, SCALARS, "song_id").where(F.abs("r") > 0.3))


def variance_ratio_by_draw(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.variance_ratio_by_draw(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag", "l_extendedprice"))


def predictive_check(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers as draws, compared with the orders that they belong to."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    seen = lines.where("l_linenumber = 1")
    return rounded(summaries.predictive_check(lines, seen, "l_returnflag", "l_linenumber", "l_quantity", 5, 45))


def convergence(spark: SparkSession, d: str) -> DataFrame:
    got = summaries.convergence(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", "l_extendedprice")
    return rounded(summaries.convergence_rules(got))


def recommended_size(spark: SparkSession, d: str) -> DataFrame:
    """The least number of lines at which the mean discount is known well enough under every return flag."""
    got = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.stddev_samp("l_discount").alias("sd"), F.count(F.lit(1)).alias("n"))
    passing = preferences.adequate(got.withColumn("se", F.col("sd") / F.sqrt("n")), {"se": ("<=", 0.002)})
    return summaries.recommended_size(passing, "l_returnflag", "l_linenumber", "passes")


def episode_predictor(spark: SparkSession, d: str) -> DataFrame:
    """Linear predictors of mixes, with terms that hold for one institution only."""
    f = table(spark, d, "features").where("rms_mean is not null and stereo_width is not null and not isnan(rms_mean) and not isnan(stereo_width)").select("feature_row_id", "song_id", "rms_mean", "stereo_width")
    terms = spark.createDataFrame([(None, "intercept", 50.0), (None, "rms_mean", 4.0), (None, "stereo_width", -2.5), ("song_tidalmeadow", "intercept", 3.0), ("song_tidalmeadow", "rms_mean", -1.5)], "song_id string, term string, beta double")
    return rounded(summaries.predictor(f, ["feature_row_id", "song_id"], terms, ["rms_mean", "stereo_width"], "song_id"))


def prediction_checks(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the rating conditions of each song, checked like predicted probabilities."""
    p = table(spark, d, "six_mix_proposals").where("song_id is not null and rating_condition is not null").groupBy("song_id", "rating_condition").agg(F.count(F.lit(1)).alias("k"))
    shares = p.join(p.groupBy("song_id").agg(F.sum("k").alias("of")), "song_id").withColumn("share", F.col("k") / F.col("of"))
    return summaries.prediction_checks(shares, "song_id", "share", 2)


def design_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the flat responses have the design's numbers."""
    r = table(spark, d, "responses_long")
    return summaries.check_table(r, {
        "scenarios": (F.count_distinct("scenario_id"), 8), "labels": (F.count_distinct(F.when(F.col("display_label").rlike("^[A-F]$"), F.col("display_label"))), 6), "positions": (F.max("display_position"), 6), "first_position": (F.min("display_position"), 1),
        "rows": (F.count(F.lit(1)), F.count("response_row_id")), "songs": (F.count_distinct("song_id"), F.count_distinct(F.lower(F.btrim("song_id")))),
    })


def mix_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of mixes in the forms that files and reports use."""
    f = table(spark, d, "features")
    path = F.concat(F.lit("audio/"), F.col("mix_id"), F.lit(".WAV"))
    parts = text.id_parts(F.col("mix_id"), r"^([A-Za-z]+)_([0-9A-Za-z]+)", ["prefix", "code"])
    return f.select("feature_row_id", text.display_label(F.col("original_mix_name"), F.col("mix_id")).alias("label"), text.song_key(F.col("artist"), F.col("song")).alias("song_key"), text.low_slug(F.col("song")).alias("slug"), text.extension(F.regexp_extract(path, r"\.([^.]*)$", 1)).alias("extension"),
        text.under_prefix(path, "audio/").alias("public"), parts["prefix"].alias("prefix"), parts["code"].alias("code"), text.config_hash(F.coalesce("mix_id", F.lit(""))).alias("hash"))


def institution_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of institutions, and of mixes by precedence."""
    f = table(spark, d, "features")
    name = F.lower("original_mix_name")
    kind = text.first_rule([(F.col("institution_code").isin("QXF", "TWKL"), "system"), (name.contains("original") | name.contains("release"), "original"), (name.contains("analog"), "analogue"), (~text.is_blank(F.col("institution_code")), "human")], "unknown")
    return f.select("feature_row_id", text.source_kind(F.col("institution_code"), ["QXF", "TWKL"]).alias("source_kind"), kind.alias("mix_kind"))


def track_groups(spark: SparkSession, d: str) -> DataFrame:
    """Source groups of parts by their names' words, with the rule's confidence."""
    rules = [("green", "vocal", "high"), ("blue|navy", "bass", "high"), ("red|rose", "drums", "medium"), (".", "other", "low")]
    got = text.grouped_name(F.col("p_name"), rules, "black")
    return table(spark, d, "part").select("p_partkey", got["group"].alias("group"), got["confidence"].alias("confidence"))


def retained_proposals(spark: SparkSession, d: str) -> DataFrame:
    return summaries.retained(table(spark, d, "six_mix_proposals").select("proposal_row_id", F.when(~F.isnan("rating_percentile_within_song"), F.col("rating_percentile_within_song")).alias("confidence")), "confidence", 0.4).select("proposal_row_id", "retained", "reason")


def first_per_institution(spark: SparkSession, d: str) -> DataFrame:
    """The first six mixes of each excerpt, one per institution."""
    f = table(spark, d, "features").where("excerpt_id is not null")
    return summaries.first_per_source(f, ["excerpt_id"], "institution_code", [F.asc("feature_row_id")], 6).select("excerpt_id", "feature_row_id", "institution_code", "position")


def reference_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix of each song whose duration and sample rate are most usual."""
    e = table(spark, d, "evaluations").where("song_id is not null and mix_id is not null and stimulus_duration_seconds is not null")
    one = e.groupBy("song_id", "mix_id").agg(F.round(F.avg("stimulus_duration_seconds"), 6).alias("duration"), F.max("stimulus_sample_rate_hz").alias("rate"), F.max(F.coalesce("mixer_institution_code", F.lit(""))).alias("code"))
    return rounded(summaries.reference_row(one, "song_id", "mix_id", "duration", "rate", [F.when(F.col("code") == "", 1.0).otherwise(0.0)]))


def rated_members(spark: SparkSession, d: str) -> DataFrame:
    """Pool members whose song and mix are rated, by a key of two columns."""
    e = table(spark, d, "evaluations").where(numeric.is_finite(F.col(SCORE)))
    f = table(spark, d, "features").where("song_id is not null and mix_id is not null")
    return summaries.members_of(f, e.where("song_id is not null and mix_id is not null"), ["song_id", "mix_id"]).select("feature_row_id", "song_id", "mix_id")


def aligned_intervals(spark: SparkSession, d: str) -> DataFrame:
    """An aligned interval of 28 s in each source's own samples."""
    f = table(spark, d, "features").where("stereo_imbalance is not null and not isnan(stereo_imbalance)")
    lag = F.round(F.col("stereo_imbalance") / 10, 3)
    start, end = excerpts.aligned_to_source(F.lit(12.5), F.lit(40.5), lag, 44_100)
    return f.select("feature_row_id", start.alias("first_sample"), end.alias("end_sample"), numeric.parse_double(F.col("institution_code"), -1.0).alias("code_number"))


QUERIES = {f.__name__: f for f in (
    rating_context, coverage_with_pool, column_examples, numeric_ranges, rating_integration_checks, described_columns, simulation_summary, filtered_maximum, tight_correlations, variance_ratio_by_draw, predictive_check, convergence, recommended_size, episode_predictor,
    prediction_checks, design_checks, mix_names, institution_kinds, track_groups, retained_proposals, first_per_institution, reference_mix, rated_members, aligned_intervals)}

_r = lambda e, n, k=6: f"round({e} + 1e-10, {k}) + 0.0 AS {n}"
_MEASURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_STATS = ", ".join(", ".join((_r(f"avg({m})", f"{m}_mean", 4), _r(f"stddev_samp({m})", f"{m}_sd", 4), _r(f"CASE WHEN count({m}) > 1 THEN stddev_samp({m}) / sqrt(count({m})) END", f"{m}_se", 4), _r(f"quantile_cont({m}, 0.5)", f"{m}_median", 4), _r(f"quantile_cont({m}, 0.1)", f"{m}_q10", 4), _r(f"quantile_cont({m}, 0.9)", f"{m}_q90", 4))) for m in _MEASURES)
_CHECK = lambda name, o, e: f"SELECT '{name}' AS \"check\", coalesce(abs(o - e) <= 1e-9, false) AS passed, o AS observed, e AS expected FROM (SELECT ({o})::DOUBLE AS o, ({e})::DOUBLE AS e FROM x)"
_FIN = lambda c: f"CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END"
_SUMMARY = """s AS (SELECT mix_id, count(*) FILTER (WHERE isfinite(preference_score_0_1)) AS n, max(song_id) AS song_id FROM evaluations WHERE mix_id IS NOT NULL GROUP BY 1)"""

SQL = {
    "rating_context": """SELECT mix_id, count(*) AS rows, count(DISTINCT session_id) AS sessions, count(DISTINCT experiment_id) AS experiments, count(DISTINCT participant_id) AS participants,
      coalesce(array_to_string(list_sort(list(DISTINCT year) FILTER (WHERE year IS NOT NULL)), '|'), '') AS years, coalesce(array_to_string(list_sort(list(DISTINCT evaluator_institution_code) FILTER (WHERE evaluator_institution_code IS NOT NULL)), '|'), '') AS institutions FROM evaluations WHERE mix_id IS NOT NULL GROUP BY 1""",
    "coverage_with_pool": f"""WITH {_SUMMARY}, p AS (SELECT DISTINCT mix_id FROM stimuli WHERE mix_id IS NOT NULL), j AS (SELECT s.*, p.mix_id IS NOT NULL AS i FROM s LEFT JOIN p USING (mix_id))
      SELECT song_id, count(*) AS items, count(*) FILTER (WHERE n > 0) AS rated, count(*) FILTER (WHERE i) AS pool_items, count(*) FILTER (WHERE i AND n > 0) AS pool_rated, min(n) FILTER (WHERE i) AS pool_least, {_r('quantile_cont(n, 0.5) FILTER (WHERE i)', 'pool_median')}, max(n) FILTER (WHERE i) AS pool_greatest,
        count(*) FILTER (WHERE i AND n < 100) AS pool_below, coalesce(array_to_string(list_sort(list(DISTINCT mix_id) FILTER (WHERE i AND n < 100)), '|'), '') AS below_items FROM j GROUP BY 1""",
    "column_examples": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, min(proposal_row_id) AS place FROM six_mix_proposals WHERE {c} IS NOT NULL GROUP BY 1, 2" for c in ("review_round", "song_id", "rating_condition", "institution_code", "alignment_status", "notes"))
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY place, value) AS k FROM c) SELECT \"column\", string_agg(value, '|' ORDER BY k) AS examples FROM r WHERE k <= 3 GROUP BY 1",
    "numeric_ranges": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_r(f'min({_FIN(c)})', 'least')}, {_r(f'max({_FIN(c)})', 'greatest')} FROM six_mix_proposals" for c in ("mean_previous_preference", "rating_count", "acoustic_pool_rank", "stereo_imbalance", "nearest_neighbour_distance")),
    "rating_integration_checks": "WITH x AS (SELECT count(*) AS n, count(participant_id) AS p, count(mix_id) AS m, count(*) FILTER (WHERE NOT preference_score_0_1 BETWEEN 0 AND 1) AS b, count(DISTINCT evaluation_id) AS d, count(evaluation_id) AS e, count(*) FILTER (WHERE preference_score_0_1 IS NULL) AS z, count(*) FILTER (WHERE evaluated_at > received_at) AS t FROM evaluations) "
    + " UNION ALL ".join((_CHECK("rows_with_participant", "p", "n"), _CHECK("rows_with_mix", "m", "n"), _CHECK("scores_within_0_1", "b", "0"), _CHECK("distinct_evaluations", "d", "e"), _CHECK("missing_scores", "z", "0"), _CHECK("evaluated_before_received", "t", "0"))),
    "described_columns": "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x FROM features WHERE isfinite({c})" for c in SCALARS)
    + f"), g AS (SELECT \"column\", count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS least, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75, max(x) AS greatest FROM l GROUP BY 1), c AS (SELECT *, CASE WHEN abs(mean) > 1e-12 THEN sd / abs(mean) END AS cov FROM g) SELECT \"column\", n, {', '.join(_r(c, c) for c in ('mean', 'sd', 'least', 'q25', 'median', 'q75', 'greatest', 'cov'))}, coalesce(cov < 0.01, sd <= 1e-12, true) AS near_constant FROM c",
    "simulation_summary": f"SELECT l_returnflag, l_linestatus, count(*) AS runs, {_STATS}, {_r('avg((l_quantity > 40)::INT)', 'large_rate', 4)}, count(*) FILTER (WHERE l_quantity > 40) AS large_total, {_r('avg((l_discount > 0.05)::INT)', 'discounted_rate', 4)}, count(*) FILTER (WHERE l_discount > 0.05) AS discounted_total FROM lineitem GROUP BY 1, 2",
    "filtered_maximum": "SELECT song_id, max(rating_count) FILTER (WHERE alignment_status = 'PASS' AND technical_qc_status = 'PASS') AS retained_greatest, max(rating_count) AS greatest, count(*) FILTER (WHERE alignment_status = 'PASS' AND technical_qc_status = 'PASS') AS retained FROM six_mix_proposals WHERE song_id IS NOT NULL GROUP BY 1",
    "tight_correlations": "WITH p AS (" + " UNION ALL ".join(f"SELECT song_id, '{a}' AS x, '{b}' AS y, CASE WHEN stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN corr({a}, {b}) END AS r, count(*) AS n FROM features WHERE song_id IS NOT NULL AND isfinite({a}) AND isfinite({b}) GROUP BY 1" for i, a in enumerate(SCALARS) for b in SCALARS[i + 1 :])
    + f") SELECT song_id, x, y, {_r('r', 'r')}, n FROM p WHERE abs(r) > 0.3",
    "variance_ratio_by_draw": f"WITH g AS (SELECT l_linenumber, l_returnflag, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), d AS (SELECT l_linenumber, var_samp(m) AS b, avg(v) AS w FROM g GROUP BY 1) SELECT l_linenumber, {_r('b', 'between_var')}, {_r('w', 'within_var')}, {_r('b / (b + w)', 'ratio')} FROM d",
    "predictive_check": f"""WITH p AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, avg((NOT l_quantity BETWEEN 5 AND 45)::INT) AS o FROM lineitem GROUP BY 1, 2), q AS (SELECT l_returnflag, avg(l_quantity) AS om, stddev_samp(l_quantity) AS os FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
      SELECT l_returnflag, count(*) AS draws, {_r('avg(m)', 'mean')}, {_r('avg(s)', 'mean_sd')}, {_r('avg(o)', 'out_of_range')}, {_r('any_value(om)', 'observed_mean')}, {_r('any_value(os)', 'observed_sd')}, {_r('avg((m >= om)::INT)', 'above')} FROM p JOIN q USING (l_returnflag) GROUP BY 1""",
    "convergence": f"""WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT l_returnflag, count(*) AS chains, sum(n)::BIGINT AS draws, avg(n) AS n, avg(v) AS w, var_samp(m) AS b FROM c GROUP BY 1),
      h AS (SELECT *, CASE WHEN chains > 1 AND w > 0 THEN sqrt(((n - 1) / n * w + b) / w) END AS r FROM g) SELECT l_returnflag, chains, draws, {_r('r', 'r_hat')}, coalesce(r <= 1.01, false) AS strict, coalesce(r <= 1.05, false) AS operational FROM h""",
    "recommended_size": """WITH g AS (SELECT l_returnflag, l_linenumber, coalesce(stddev_samp(l_discount) / sqrt(count(*)) <= 0.002, false) AS p FROM lineitem GROUP BY 1, 2), o AS (SELECT count(DISTINCT l_returnflag) AS k, max(l_linenumber) AS g FROM g), s AS (SELECT l_linenumber, count(*) FILTER (WHERE p) AS c FROM g GROUP BY 1),
      m AS (SELECT min(CASE WHEN c = k THEN l_linenumber END) AS e, min(CASE WHEN c > 0 AND c * 2 > k THEN l_linenumber END) AS m, any_value(g) AS g FROM s, o) SELECT coalesce(e, m, g) AS size, CASE WHEN e IS NOT NULL THEN 'all_scenarios' WHEN m IS NOT NULL THEN 'most_scenarios' ELSE 'greatest_size' END AS rule FROM m""",
    "episode_predictor": f"""SELECT feature_row_id, song_id, {_r("50 + 4 * rms_mean - 2.5 * stereo_width + CASE WHEN song_id = 'song_tidalmeadow' THEN 3 - 1.5 * rms_mean ELSE 0 END", 'eta')} FROM features WHERE isfinite(rms_mean) AND isfinite(stereo_width)""",
    "prediction_checks": """WITH p AS (SELECT song_id, rating_condition, count(*) AS k FROM six_mix_proposals WHERE song_id IS NOT NULL AND rating_condition IS NOT NULL GROUP BY 1, 2), s AS (SELECT song_id, k, k / sum(k) OVER (PARTITION BY song_id) AS p, max(k) OVER (PARTITION BY song_id) AS m FROM p)
      SELECT song_id, unnest(['candidates', 'within_0_1', 'adds_up_to_1', 'one_winner']) AS "check", unnest([count(*) = 2, bool_and(p BETWEEN 0 AND 1), abs(sum(p) - 1) <= 1e-6, count(*) FILTER (WHERE k = m) = 1]) AS passed FROM s GROUP BY 1""",
    "design_checks": "WITH x AS (SELECT count(DISTINCT scenario_id) AS s, count(DISTINCT CASE WHEN regexp_full_match(display_label, '[A-F]') THEN display_label END) AS l, max(display_position) AS p, min(display_position) AS q, count(*) AS n, count(response_row_id) AS m, count(DISTINCT song_id) AS g, count(DISTINCT lower(trim(song_id))) AS h FROM responses_long) "
    + " UNION ALL ".join((_CHECK("scenarios", "s", "8"), _CHECK("labels", "l", "6"), _CHECK("positions", "p", "6"), _CHECK("first_position", "q", "1"), _CHECK("rows", "n", "m"), _CHECK("songs", "g", "h"))),
    "mix_names": """SELECT feature_row_id, CASE WHEN coalesce(trim(mix_id), '') = '' THEN original_mix_name ELSE original_mix_name || ' (' || mix_id || ')' END AS label, concat_ws(' - ', artist, song) AS song_key, replace(lower(song), ' ', '_') AS slug, CASE WHEN mix_id IS NOT NULL THEN '.wav' END AS extension, mix_id IS NOT NULL AS public,
      CASE WHEN regexp_matches(mix_id, '^([A-Za-z]+)_([0-9A-Za-z]+)') THEN regexp_extract(mix_id, '^([A-Za-z]+)_([0-9A-Za-z]+)', 1) END AS prefix, CASE WHEN regexp_matches(mix_id, '^([A-Za-z]+)_([0-9A-Za-z]+)') THEN regexp_extract(mix_id, '^([A-Za-z]+)_([0-9A-Za-z]+)', 2) END AS code, sha256(coalesce(mix_id, ''))[1:16] AS hash FROM features""",
    "institution_kinds": """SELECT feature_row_id, CASE WHEN coalesce(trim(institution_code), '') = '' THEN 'unknown' WHEN institution_code IN ('QXF', 'TWKL') THEN 'automated' ELSE 'institution' END AS source_kind, CASE WHEN institution_code IN ('QXF', 'TWKL') THEN 'system' WHEN lower(original_mix_name) LIKE '%original%' OR lower(original_mix_name) LIKE '%release%' THEN 'original'
      WHEN lower(original_mix_name) LIKE '%analog%' THEN 'analogue' WHEN coalesce(trim(institution_code), '') <> '' THEN 'human' ELSE 'unknown' END AS mix_kind FROM features""",
    "track_groups": """WITH n AS (SELECT p_partkey, lower(replace(p_name, ' ', '')) AS n FROM part), g AS (SELECT p_partkey, n, CASE WHEN n LIKE '%green%' THEN 1 WHEN n LIKE '%blue%' OR n LIKE '%navy%' THEN 2 WHEN n LIKE '%red%' OR n LIKE '%rose%' THEN 3 WHEN n <> '' THEN 4 END AS k FROM n)
      SELECT p_partkey, CASE WHEN n NOT LIKE '%black%' THEN ['vocal', 'bass', 'drums', 'other'][k] END AS "group", CASE WHEN n NOT LIKE '%black%' THEN ['high', 'high', 'medium', 'low'][k] END AS confidence FROM g""",
    "retained_proposals": "SELECT proposal_row_id, coalesce(NOT isnan(rating_percentile_within_song) AND rating_percentile_within_song >= 0.4, false) AS retained, CASE WHEN coalesce(NOT isnan(rating_percentile_within_song) AND rating_percentile_within_song >= 0.4, false) THEN '' ELSE 'confidence below 0.40' END AS reason FROM six_mix_proposals",
    "first_per_institution": """WITH o AS (SELECT *, CASE WHEN coalesce(trim(institution_code), '') <> '' THEN institution_code END AS s FROM features WHERE excerpt_id IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY excerpt_id, s ORDER BY feature_row_id) AS r FROM o), b AS (SELECT *, (row_number() OVER (PARTITION BY excerpt_id ORDER BY feature_row_id))::INTEGER AS position FROM a WHERE s IS NULL OR r = 1)
      SELECT excerpt_id, feature_row_id, institution_code, position FROM b WHERE position <= 6""",
    "reference_mix": f"""WITH o AS (SELECT song_id, mix_id, round(avg(stimulus_duration_seconds), 6) AS du, max(stimulus_sample_rate_hz) AS rate, max(coalesce(mixer_institution_code, '')) AS code FROM evaluations WHERE song_id IS NOT NULL AND mix_id IS NOT NULL AND stimulus_duration_seconds IS NOT NULL GROUP BY 1, 2),
      m AS (SELECT song_id, quantile_cont(du, 0.5) AS mid FROM o GROUP BY 1), c AS (SELECT song_id, rate AS common FROM (SELECT song_id, rate, count(*) AS k FROM o GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY k DESC, rate NULLS FIRST) = 1),
      s AS (SELECT song_id, mix_id, round(abs(du - mid) + CASE WHEN rate IS NOT DISTINCT FROM common THEN 0 ELSE 1 END + CASE WHEN code = '' THEN 1 ELSE 0 END, 9) AS score FROM o JOIN m USING (song_id) JOIN c USING (song_id)) SELECT song_id, mix_id, {_r('score', 'score')} FROM s QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY score, mix_id) = 1""",
    "rated_members": "SELECT feature_row_id, song_id, mix_id FROM features f WHERE EXISTS (SELECT 1 FROM evaluations e WHERE e.song_id = f.song_id AND e.mix_id = f.mix_id AND isfinite(e.preference_score_0_1))",
    "aligned_intervals": "SELECT feature_row_id, round((12.5 + round(stereo_imbalance / 10, 3)) * 44100)::BIGINT AS first_sample, round((40.5 + round(stereo_imbalance / 10, 3)) * 44100)::BIGINT AS end_sample, coalesce(TRY_CAST(institution_code AS DOUBLE), -1.0) AS code_number FROM features WHERE stereo_imbalance IS NOT NULL AND NOT isnan(stereo_imbalance)",
}
