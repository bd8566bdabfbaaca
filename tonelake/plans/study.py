"""Queries of preferences, time lines, signals, response checks and study design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions.text import id_key, is_blank, strip_blanks
from tonelake.operators import design, inventory, nested, preferences, quality, signals
from tonelake.plans.ratings import SCALARS, rounded
from tonelake.sources.records import label_ok, rating_ok, version_label
from tonelake.sources.tables import table

TRIAL = ["study_id", "trial_index"]
STATUS, PRIORITY = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rated(spark: SparkSession, d: str) -> DataFrame:
    """Readable ratings of identified submissions, each repeated row once."""
    r = table(spark, d, "responses_long").where(rating_ok(F.col("rating")) & ~is_blank(F.col("study_id")) & F.col("trial_index").isNotNull() & id_key(F.col("stimulus_id")).isNotNull())
    return r.select(*TRIAL, id_key(F.col("stimulus_id")).alias("stimulus"), strip_blanks(F.col("rating")).cast("int").alias("score"))


def winner_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return preferences.winners(_rated(spark, d), TRIAL, "stimulus", "score")


def joint_winners(spark: SparkSession, d: str) -> DataFrame:
    return preferences.joint_winners(winner_with_ties(spark, d), TRIAL)


def derived_preference(spark: SparkSession, d: str) -> DataFrame:
    return preferences.derived_preference(winner_with_ties(spark, d), TRIAL)


def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return preferences.pivot_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", STATUS)


def pivot_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preferences.pivot_means(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", STATUS, "o_totalprice"))


def level_grid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evaluations").where("experiment_id is not null and mixer_institution_code is not null")
    return rounded(preferences.level_grid(e, "experiment_id", "mixer_institution_code", "preference_score_0_1"))


def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return preferences.histogram(table(spark, d, "orders"), "o_totalprice", 0.0, 500_000.0, 20)


def pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preferences.pearson_pairs(table(spark, d, "lineitem"), MEASURES))


def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the scalar features, over the rows that have them all."""
    return rounded(preferences.spearman_pairs(table(spark, d, "features").where("song_id is not null"), SCALARS, "song_id"))


def quartile_bins(spark: SparkSession, d: str) -> DataFrame:
    return preferences.quantile_bins(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", [0.25, 0.5, 0.75]).select("p_partkey", "bin")


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("preference_score_0_1").between(0, 1), F.col("preference_score_0_1"))
    e = table(spark, d, "evaluations").where("evaluated_at is not null").groupBy(F.date_format("evaluated_at", "yyyy-MM").alias("month"))
    return e.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"))


def lag_changes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preferences.changes(_monthly(spark, d), "month", ["n", "mean", "sd"]))


def adequacy_rules(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preferences.adequate(_monthly(spark, d), {"se": ("<=", 0.02), "n": (">=", 100), "sd": ("<=", 0.3)}).select("month", "n", "se", "sd", "passes"))


def minimum_passing(spark: SparkSession, d: str) -> DataFrame:
    """The least list position at which a song's listeners agree, and the least one at which all songs' do."""
    x = F.when(F.col("preference_score_0_1").between(0, 1), F.col("preference_score_0_1"))
    e = table(spark, d, "evaluations").where("song_id is not null and mix_order_in_xml is not null").groupBy("song_id", "mix_order_in_xml").agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"))
    return preferences.least_passing(preferences.adequate(e, {"sd": ("<=", 0.27), "n": (">=", 3)}), "song_id", "mix_order_in_xml")


def winner_probability(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding dimension as a draw, the vectors of a label as the competing items."""
    draws = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("draw", "v")).withColumn("v", F.round(F.col("v").cast("double"), 2))
    return rounded(preferences.winner_probability(draws, "label", "draw", "vec_id", "v"))


def narrowest_interval(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evaluations").where("preference_score_0_1 between 0 and 1 and mix_id is not null")
    return rounded(preferences.narrowest_interval(e, "mix_id", "preference_score_0_1"))


def tail_interval(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evaluations").where("preference_score_0_1 between 0 and 1")
    return rounded(preferences.tail_interval(e, "song_id", "preference_score_0_1"))


def recovery_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "six_mix_proposals").where("isnan(mean_previous_preference) = false and isnan(median_previous_preference) = false and mean_previous_preference between 0 and 1 and median_previous_preference between 0 and 1")
    m = F.col("mean_previous_preference")
    return rounded(preferences.recovery(p, "rating_condition", m, F.col("median_previous_preference"), m - 0.05, m + 0.05))


def variance_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(preferences.variance_ratio(table(spark, d, "evaluations").where("preference_score_0_1 between 0 and 1 and mix_id is not null"), "mix_id", "preference_score_0_1"))


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, spread, error, median, tails, rate and sum per event type in one aggregate."""
    e = table(spark, d, "events").groupBy("event_type")
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    got = e.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"), F.avg((F.col("value") > 50).cast("double")).alias("rate"), F.sum("value").alias("total"))
    return rounded(got.select("event_type", "n", "mean", "sd", F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n")).alias("se"), F.col("q")[0].alias("q10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q90"), "rate", "total"))


def _curves(spark: SparkSession, d: str) -> DataFrame:
    """Hourly activity of each event type: (event_type, hour, events, value)."""
    e = table(spark, d, "events").where("ts is not null and event_type is not null")
    return e.groupBy("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour")).agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("value"))


def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Mean activity within windows of 24 hours every 12 hours and their shifts by up to 3 hours."""
    c = _curves(spark, d)
    spans = c.groupBy("event_type").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    starts = spans.select("event_type", F.explode(F.sequence("lo", "hi", F.lit(12).cast("bigint"))).alias("s")).select("event_type", F.explode(F.array(F.col("s") - 3, F.col("s"), F.col("s") + 3)).alias("start"))
    w = starts.withColumn("end", F.col("start") + 24)
    return rounded(signals.coverage(w, c.select("event_type", "hour", F.col("events").cast("double").alias("events")), "event_type", "start", "end", "hour", "events", 24.0))


def common_overlap(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").where("ts is not null").groupBy("event_type", "user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b"))
    return rounded(signals.common_overlap(users, "event_type", F.col("a") / 1e6, F.col("b") / 1e6))


def greedy_separated_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signals.separated_top(_curves(spark, d), "event_type", "hour", "value", 5, 24.0))


def _lags(spark: SparkSession, d: str) -> DataFrame:
    """Lag correlations of the first two event types by name."""
    c = _curves(spark, d)
    first = c.agg(F.min("event_type").alias("event_type"))  # one row each
    second = c.join(F.broadcast(first.withColumnRenamed("event_type", "_f")), F.col("event_type") > F.col("_f")).agg(F.min("event_type").alias("event_type"))
    one, two = (c.join(F.broadcast(t), "event_type", "left_semi").select("hour", F.col("events").cast("double").alias("v")) for t in (first, second))
    return signals.lag_correlations(one, two, "hour", "v", 5)


def lag_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_lags(spark, d))


def lag_estimate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signals.best_lag(_lags(spark, d)))


def edge_grade(spark: SparkSession, d: str) -> DataFrame:
    """Grades of neighbouring pool members as if offset and correlation, rolled up to the worst per excerpt."""
    f = table(spark, d, "features").where("excerpt_id is not null and stereo_imbalance is not null and not isnan(stereo_imbalance) and stereo_width is not null and not isnan(stereo_width)")
    g = signals.grade(F.col("stereo_imbalance") / 100, (F.col("stereo_width") + 4) / 8)
    return f.groupBy("excerpt_id").agg(signals.worst_status(g).alias("status"), F.count_if(g == "PASS").alias("passed"), F.count_if(g == "REVIEW").alias("review"), F.count_if(g == "FAIL").alias("failed"))


def rolling_rise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signals.rolling_rise(_curves(spark, d), "event_type", "hour", "value").select("event_type", "hour", "rise"))


def _stereo(spark: SparkSession, d: str) -> DataFrame:
    """The two halves of each 48-band vector as a left and a right channel."""
    return table(spark, d, "features").where(F.size("bark") == 48).select("feature_row_id", F.slice("bark", 1, 24).alias("left"), F.slice("bark", 25, 24).alias("right"), "bark")


def signal_levels(spark: SparkSession, d: str) -> DataFrame:
    left, right = F.col("left"), F.col("right")
    got = _stereo(spark, d).select("feature_row_id", signals.rms(left).alias("rms_left"), signals.rms(right).alias("rms_right"), signals.crest_db(left).alias("crest_left"), signals.stereo_width(left, right).alias("width"), signals.stereo_imbalance(left, right).alias("imbalance"))
    return rounded(got)


def signal_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Standardised values, rises and faded values by position."""
    got = _stereo(spark, d).select("feature_row_id", signals.standardised(F.col("bark")).alias("z"), signals.onset(F.col("bark")).alias("rise"), signals.faded(F.col("bark"), 4).alias("faded"))
    return rounded(got.select("feature_row_id", F.posexplode(F.arrays_zip("z", "rise", "faded")).alias("pos", "s")).select("feature_row_id", "pos", "s.z", "s.rise", "s.faded"))


def signal_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return _stereo(spark, d).select("feature_row_id", signals.fingerprint(F.col("bark"), 8).alias("fingerprint"))


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    got = signals.envelopes(_stereo(spark, d), "feature_row_id", "bark", 8, 4)
    return rounded(got.select(F.col("key").cast("bigint").alias("feature_row_id"), F.posexplode("envelope").alias("frame", "level")))


def flatten_json(spark: SparkSession, d: str) -> DataFrame:
    """The properties of events as typed columns, with a code for what cannot be read."""
    e = table(spark, d, "events").withColumn("v", F.expr("try_parse_json(props)"))
    k = F.expr("try_variant_get(v, '$.k', 'bigint')")
    return e.select("event_id", k.alias("k"), F.when(F.coalesce(F.trim("props"), F.lit("")) == "", "missing_json").when(F.col("v").isNull(), "malformed_json").when(k.isNull(), "missing_key").otherwise("ok").alias("state"))


def json_issue_log(spark: SparkSession, d: str) -> DataFrame:
    """Issues of flattened responses, a row each: codes of missing fields, ratings, labels and repeated labels of a trial."""
    leaf = nested.Ancestor("responses", nested.RESPONSES.steps, ("trial_index", "episode_id", "song_id", "display_label", "stimulus_id", "rating"))
    r = nested.shred(table(spark, d, "submissions"), "submission_row_id", {"responses_json": [leaf]})
    c = lambda x: F.col(f"leaf_{x}")
    same = F.count(F.lit(1)).over(W.partitionBy("row_id", c("trial_index"), c("display_label")))
    rules = {
        "missing_stimulus_id": ("stimulus_id", is_blank(c("stimulus_id"))), "missing_response_field": ("episode_id", is_blank(c("episode_id"))), "rating_not_integer_0_100": ("rating", ~rating_ok(c("rating"))),
        "invalid_label": ("display_label", ~label_ok(c("display_label"))), "duplicate_response_within_trial": ("display_label", F.col("same") > 1),
    }
    return quality.issues(r.withColumn("same", same), ["row_id", "path"], rules).withColumnRenamed("row_id", "submission_row_id")


def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return json_issue_log(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("submission_row_id").alias("submissions"))


def trial_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Per trial: its labels in display order, how many, distinct stimuli, and notes on repeated labels and differing comments."""
    r = table(spark, d, "responses_long").where(~is_blank(F.col("study_id")) & F.col("trial_index").isNotNull() & F.col("display_position").isNotNull())
    r = r.select(*TRIAL, "display_position", F.coalesce(version_label(F.col("display_label")), F.lit("")).alias("label"), id_key(F.col("stimulus_id")).alias("stimulus"), "comparative_comment").distinct()
    got = r.groupBy(*TRIAL).agg(F.array_sort(F.collect_set(F.struct("display_position", "label"))).alias("o"), F.count_distinct("stimulus").alias("stimuli"), F.count_distinct("comparative_comment").alias("comments"))
    order = F.array_join(F.transform("o", lambda s: s["label"]), " | ")
    labels = F.transform("o", lambda s: s["label"])
    notes = F.array_join(F.array_compact(F.array(F.when(F.size(F.array_distinct(labels)) < F.size(labels), F.lit("duplicate_label")), F.when(F.col("comments") > 1, F.lit("inconsistent_trial_comments")), F.when(F.size("o") != 6, F.lit("unexpected_mix_count")))), ";")
    return got.select(*TRIAL, order.alias("display_order"), F.size("o").alias("labels"), "stimuli", notes.alias("notes"))


def first_appearance(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of each study in order of their first trial."""
    r = table(spark, d, "responses_long").where(~is_blank(F.col("study_id")) & F.col("trial_index").isNotNull() & id_key(F.col("episode_id")).isNotNull())
    first = r.groupBy("study_id", id_key(F.col("episode_id")).alias("episode")).agg(F.min("trial_index").alias("first_trial"))
    return first.withColumn("position", F.dense_rank().over(W.partitionBy("study_id").orderBy("first_trial", "episode")))


def feature_quality_checks(spark: SparkSession, d: str) -> DataFrame:
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    checks = {f"finite_{c}": ("error", bad(c)) for c in SCALARS} | {"known_institution": ("warning", is_blank(F.col("institution_code"))), "band_count": ("error", F.size("bark") != 48), "mean_of_channels": ("warning", F.abs(F.col("rms_mean") - (F.col("rms_left") + F.col("rms_right")) / 2) > 10)}
    return quality.check_rows(table(spark, d, "features"), "song_id", checks)


def repeated_vectors(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeated_vectors(table(spark, d, "features").where("bark is not null"), "excerpt_id", "feature_row_id", "bark", 4)


def ambiguous_mapping(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "responses_long").select(id_key(F.col("stimulus_id")).alias("stimulus"), F.col("actual_mix_id"))
    return quality.ambiguous(r, "stimulus", "actual_mix_id")


def population_gaps(spark: SparkSession, d: str) -> DataFrame:
    key = lambda t, c: table(spark, d, t).select(F.col(c).alias("mix_id")).where("mix_id is not null")
    return quality.population_gaps(key("evaluations", "mix_id"), key("stimuli", "mix_id"), ["mix_id"])


def compare_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Stated distances of selections against each other's formula: mean within least and greatest."""
    s = table(spark, d, "selection_method_comparison").select("selection_id", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("minimum_pairwise_distance", "mean_pairwise_distance", "maximum_pairwise_distance")))
    other = s.select("selection_id", F.least("minimum_pairwise_distance", "mean_pairwise_distance").alias("minimum_pairwise_distance"), F.greatest("mean_pairwise_distance", "maximum_pairwise_distance").alias("maximum_pairwise_distance"))
    return rounded(quality.compare(s, other, ["selection_id"], ["minimum_pairwise_distance", "maximum_pairwise_distance"]))


def design_blocks(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "responses_long").where(~is_blank(F.col("study_id"))).select("study_id", id_key(F.col("episode_id")).alias("episode"), id_key(F.col("song_id")).alias("song")).where("episode is not null and song is not null").distinct()
    return design.blocked_order(r, "study_id", "episode", "song", seed=42)


def sticky_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Studies keep a known group; others get one fixed by their id."""
    r = table(spark, d, "responses_long").where(~is_blank(F.col("study_id"))).groupBy("study_id").agg(F.min("study_group").alias("assigned"))
    return design.assign(r.select("study_id"), "study_id", ["A", "B", "C"], r, seed=42)


def scenario_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(design.scenario_grid(spark, {"moderate": 1.0, "smaller": 0.6, "noisy": 1.0}, [20, 30, 40, 50, 60, 80], 20))


def simulated_ratings(spark: SparkSession, d: str) -> DataFrame:
    mixes = table(spark, d, "evaluations").where("preference_score_0_1 between 0 and 1 and mix_id is not null").groupBy("mix_id").agg((100 * F.avg("preference_score_0_1")).alias("effect"))
    return design.simulated_ratings(spark, 20, mixes, "mix_id", "effect", 10.0, seed=42).withColumn("expected", F.round("expected", 6))


QUERIES = {f.__name__: f for f in (
    winner_with_ties, joint_winners, derived_preference, pivot_counts, pivot_mean, level_grid, histogram_bins, pearson_pairs, spearman_pairs, quartile_bins, lag_changes, adequacy_rules, minimum_passing, winner_probability, narrowest_interval, tail_interval,
    recovery_metrics, variance_ratio, metric_summary, interval_coverage, common_overlap, greedy_separated_topk, lag_correlation, lag_estimate, edge_grade, rolling_rise, signal_levels, signal_shapes, signal_fingerprints, envelopes, flatten_json, json_issue_log,
    issue_counts, trial_metadata, first_appearance, feature_quality_checks, repeated_vectors, ambiguous_mapping, population_gaps, compare_tolerance, design_blocks, sticky_assignment, scenario_grid, simulated_ratings)}

_r = lambda e, n: f"round({e} + 1e-10, 6) + 0.0 AS {n}"
_BL = "' ' || chr(9)"
_KEY = lambda c: f"nullif(lower(trim({c}, {_BL})), '')"
_GOOD = f"coalesce(regexp_full_match(trim(rating, {_BL}), '[0-9]{{1,2}}|0[0-9]{{2}}|100'), false)"
_TRIALS = f"""rated AS (SELECT study_id, trial_index, {_KEY('stimulus_id')} AS stimulus, trim(rating, {_BL})::INTEGER AS score FROM responses_long WHERE {_GOOD} AND coalesce(trim(study_id, ' '), '') <> '' AND trial_index IS NOT NULL AND {_KEY('stimulus_id')} IS NOT NULL),
top AS (SELECT *, max(score) OVER (PARTITION BY study_id, trial_index) AS best, count(*) OVER (PARTITION BY study_id, trial_index) AS scored FROM rated),
w AS (SELECT study_id, trial_index, best, string_agg(DISTINCT stimulus, '|' ORDER BY stimulus) AS winners, count(DISTINCT stimulus)::INTEGER AS winner_count, count(DISTINCT stimulus) > 1 AS tie, any_value(scored) AS scored FROM top WHERE score = best GROUP BY 1, 2, 3)"""
_MONTHLY = """m AS (SELECT strftime(evaluated_at, '%Y-%m') AS month, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, stddev_samp(x) / sqrt(count(x)) AS se
  FROM (SELECT evaluated_at, CASE WHEN preference_score_0_1 BETWEEN 0 AND 1 THEN preference_score_0_1 END AS x FROM evaluations) WHERE evaluated_at IS NOT NULL GROUP BY 1)"""
_CURVES = "c AS (SELECT event_type, (epoch_us(ts) // 3600000000)::BIGINT AS hour, count(*) AS events, avg(value) AS value FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2)"
_LAGS = f"""{_CURVES}, u AS (SELECT hour, events::DOUBLE AS v FROM c WHERE event_type = (SELECT min(event_type) FROM c)), z AS (SELECT hour, events::DOUBLE AS v FROM c WHERE event_type = (SELECT min(event_type) FROM c WHERE event_type > (SELECT min(event_type) FROM c))),
  lags AS (SELECT lag::INTEGER AS lag, count(*) AS n, CASE WHEN count(*) <= 4 OR stddev_pop(u.v) < 1e-12 OR stddev_pop(z.v) < 1e-12 THEN -1 ELSE corr(u.v, z.v) END AS r FROM u, (SELECT unnest(range(-5, 6)) AS lag) JOIN z ON z.hour = u.hour + lag GROUP BY 1)"""
_STEREO = "s AS (SELECT feature_row_id, bark, bark[1:24] AS l, bark[25:48] AS r FROM features WHERE len(bark) = 48)"
_sum = lambda a, e: f"list_sum(list_transform({a}, lambda v: {e}))"
_zip = lambda e: f"list_sum(list_transform(list_zip(l, r), lambda p: {e}))"


def _pairs(columns: list[str], source: str, group: str | None = None) -> str:
    by = f"{group}, " if group else ""
    one = lambda a, b: f"SELECT {by}'{a}' AS x, '{b}' AS y, round(CASE WHEN stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN corr({a}, {b}) END + 1e-10, 6) + 0.0 AS r, count(*) AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" + (f" GROUP BY {group}" if group else "")
    return " UNION ALL ".join(one(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :])


_CHECKS = [(f"finite_{c}", "error", f"NOT coalesce(isfinite({c}), false)") for c in SCALARS] + [
    ("known_institution", "warning", "coalesce(trim(institution_code, ' '), '') = ''"), ("band_count", "error", "len(bark) <> 48"), ("mean_of_channels", "warning", "abs(rms_mean - (rms_left + rms_right) / 2) > 10"),
]

#: the objects of the responses in strict cells; DuckDB's own parser is laxer, so such cells are told by what stands outside strings
_RESPONSE_CELLS = r"""cells AS (SELECT submission_row_id, CASE WHEN json_valid(responses_json) AND NOT regexp_matches(regexp_replace(responses_json, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}]|(?i:nan|inf)|/') THEN responses_json::JSON END AS r FROM submissions),
ar AS (SELECT submission_row_id, r, unnest(range(json_array_length(r)::BIGINT)) AS i FROM cells WHERE json_type(r) = 'ARRAY'),
ob AS (SELECT * FROM (SELECT submission_row_id, i, json_extract(r, '$[' || i || ']') AS o FROM ar) WHERE json_type(o) = 'OBJECT')"""
_ISSUE_LOG = """f AS (SELECT submission_row_id, i::VARCHAR AS path, json_extract_string(o, '$.trial_index') AS trial, json_extract_string(o, '$.episode_id') AS episode, json_extract_string(o, '$.display_label') AS label, json_extract_string(o, '$.stimulus_id') AS stimulus, json_extract_string(o, '$.rating') AS rating FROM ob),
g AS (SELECT *, count(*) OVER (PARTITION BY submission_row_id, trial, label) AS same FROM f),
log AS (SELECT submission_row_id, path, 'missing_stimulus_id' AS code, 'stimulus_id' AS field FROM g WHERE coalesce(trim(stimulus), '') = ''
UNION ALL SELECT submission_row_id, path, 'missing_response_field', 'episode_id' FROM g WHERE coalesce(trim(episode), '') = ''
UNION ALL SELECT submission_row_id, path, 'rating_not_integer_0_100', 'rating' FROM g WHERE NOT coalesce(regexp_full_match(trim(rating, ' ' || chr(9)), '[0-9]{1,3}') AND try_cast(trim(rating, ' ' || chr(9)) AS INTEGER) <= 100, false)
UNION ALL SELECT submission_row_id, path, 'invalid_label', 'display_label' FROM g WHERE NOT coalesce(regexp_full_match(regexp_replace(trim(label, ' ' || chr(9)), '^(?i:version)[ \\t]+', ''), '[A-F]'), false)
UNION ALL SELECT submission_row_id, path, 'duplicate_response_within_trial', 'display_label' FROM g WHERE same > 1)"""

SQL = {
    "winner_with_ties": f"WITH {_TRIALS} SELECT * FROM w",
    "joint_winners": f"WITH {_TRIALS} SELECT study_id, trial_index, unnest(string_split(winners, '|')) AS winner FROM w WHERE tie",
    "derived_preference": f"WITH {_TRIALS} SELECT study_id, trial_index, CASE WHEN NOT tie THEN winners END AS preferred, CASE WHEN tie THEN winners ELSE '' END AS tied FROM w",
    "pivot_counts": "SELECT o_orderpriority, " + ", ".join(f'count(*) FILTER (WHERE o_orderstatus = \'{s}\') AS "{s}"' for s in STATUS) + " FROM orders GROUP BY 1",
    "pivot_mean": "SELECT o_orderpriority, " + ", ".join(_r(f"avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}')", f'"{s}"') for s in STATUS) + " FROM orders GROUP BY 1",
    "level_grid": f"""WITH e AS (SELECT * FROM evaluations WHERE experiment_id IS NOT NULL AND mixer_institution_code IS NOT NULL), a AS (SELECT DISTINCT experiment_id FROM e), b AS (SELECT DISTINCT mixer_institution_code FROM e)
      SELECT experiment_id, mixer_institution_code, count(preference_score_0_1) AS n, {_r('avg(preference_score_0_1)', 'mean')}, {_r('stddev_samp(preference_score_0_1)', 'sd')}, {_r('min(preference_score_0_1)', 'least')}, {_r('max(preference_score_0_1)', 'greatest')}
      FROM a CROSS JOIN b LEFT JOIN e USING (experiment_id, mixer_institution_code) GROUP BY 1, 2""",
    "histogram_bins": "SELECT (CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 21 ELSE floor(o_totalprice / 25000) + 1 END)::INTEGER AS bin, count(*) AS rows FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1",
    "pearson_pairs": _pairs(MEASURES, "lineitem"),
    "spearman_pairs": "WITH f AS (SELECT * FROM features WHERE song_id IS NOT NULL AND " + " AND ".join(f"isfinite({c})" for c in SCALARS) + "), k AS (SELECT song_id, " + ", ".join(f"rank() OVER (PARTITION BY song_id ORDER BY {c}) + (count(*) OVER (PARTITION BY song_id, {c}) - 1) / 2.0 AS {c}" for c in SCALARS) + " FROM f) " + _pairs(SCALARS, "k", "song_id"),
    "quartile_bins": "SELECT p_partkey, CASE WHEN p_retailprice IS NOT NULL THEN 1 + (p_retailprice > q[1])::INT + (p_retailprice > q[2])::INT + (p_retailprice > q[3])::INT END AS bin FROM part, (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part)",
    "lag_changes": f"WITH {_MONTHLY} SELECT month, n, {_r('mean', 'mean')}, {_r('sd', 'sd')}, {_r('se', 'se')}, n - lag(n) OVER o AS n_change, {_r('mean - lag(mean) OVER o', 'mean_change')}, {_r('sd - lag(sd) OVER o', 'sd_change')} FROM m WINDOW o AS (ORDER BY month)",
    "adequacy_rules": f"WITH {_MONTHLY} SELECT month, n, {_r('se', 'se')}, {_r('sd', 'sd')}, coalesce(m.se <= 0.02, false) AND n >= 100 AND coalesce(m.sd <= 0.3, false) AS passes FROM m",
    "minimum_passing": """WITH e AS (SELECT song_id, mix_order_in_xml AS p, count(x) AS n, stddev_samp(x) AS sd FROM (SELECT *, CASE WHEN preference_score_0_1 BETWEEN 0 AND 1 THEN preference_score_0_1 END AS x FROM evaluations) WHERE song_id IS NOT NULL AND mix_order_in_xml IS NOT NULL GROUP BY 1, 2),
      a AS (SELECT *, coalesce(sd <= 0.27, false) AND n >= 3 AS passes FROM e)
      SELECT song_id, min(p) FILTER (WHERE passes) AS least_size, (SELECT min(p) FROM (SELECT p FROM a GROUP BY p HAVING bool_and(passes) AND count(DISTINCT song_id) = (SELECT count(DISTINCT song_id) FROM a))) AS recommended FROM a GROUP BY 1""",
    "winner_probability": f"""WITH d AS (SELECT label, vec_id, unnest(range(len(embedding))) AS draw, round(unnest(embedding)::DOUBLE, 2) AS v FROM embeddings), t AS (SELECT *, (v = max(v) OVER (PARTITION BY label, draw))::INT AS won FROM d), k AS (SELECT *, sum(won) OVER (PARTITION BY label, draw) AS k FROM t)
      SELECT label, vec_id, {_r('avg(won / k)', 'probability')}, {_r('avg(CASE WHEN won = 1 AND k > 1 THEN 1.0 ELSE 0.0 END)', 'tie_probability')} FROM k GROUP BY 1, 2""",
    "narrowest_interval": f"""WITH x AS (SELECT mix_id, preference_score_0_1 AS v, row_number() OVER (PARTITION BY mix_id ORDER BY preference_score_0_1) AS i, count(*) OVER (PARTITION BY mix_id) AS n FROM evaluations WHERE preference_score_0_1 BETWEEN 0 AND 1 AND mix_id IS NOT NULL),
      p AS (SELECT a.mix_id, a.n, a.v AS lo, b.v AS hi FROM x a JOIN x b ON a.mix_id = b.mix_id AND b.i = a.i + floor(0.94::DOUBLE * a.n)::INT), k AS (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY round(hi - lo, 12), lo, hi) AS rn FROM p)
      SELECT mix_id, n, {_r('lo', 'low')}, {_r('hi', 'high')} FROM k WHERE rn = 1""",
    "tail_interval": f"SELECT song_id, {_r('avg(preference_score_0_1)', 'mean')}, {_r('quantile_cont(preference_score_0_1, 0.03)', 'low')}, {_r('quantile_cont(preference_score_0_1, 0.97)', 'high')} FROM evaluations WHERE preference_score_0_1 BETWEEN 0 AND 1 GROUP BY 1",
    "recovery_metrics": f"""WITH p AS (SELECT rating_condition, mean_previous_preference AS m, median_previous_preference AS t, mean_previous_preference - median_previous_preference AS e FROM six_mix_proposals WHERE NOT isnan(mean_previous_preference) AND NOT isnan(median_previous_preference) AND mean_previous_preference BETWEEN 0 AND 1 AND median_previous_preference BETWEEN 0 AND 1)
      SELECT rating_condition, count(*) AS n, {_r('avg(e)', 'bias')}, {_r('avg(abs(e))', 'mae')}, {_r('sqrt(avg(e * e))', 'rmse')}, {_r('avg((t BETWEEN m - 0.05 AND m + 0.05)::INT::DOUBLE)', 'covered')}, {_r('avg((m + 0.05) - (m - 0.05))', 'width')}, {_r('avg((sign(m) = sign(t))::INT::DOUBLE)', 'sign')} FROM p GROUP BY 1""",
    "variance_ratio": f"WITH g AS (SELECT mix_id, avg(preference_score_0_1) AS m, var_samp(preference_score_0_1) AS v FROM evaluations WHERE preference_score_0_1 BETWEEN 0 AND 1 AND mix_id IS NOT NULL GROUP BY 1) SELECT {_r('var_samp(m)', 'between_var')}, {_r('avg(v)', 'within_var')}, {_r('var_samp(m) / (var_samp(m) + avg(v))', 'ratio')} FROM g",
    "metric_summary": f"SELECT event_type, count(value) AS n, {_r('avg(value)', 'mean')}, {_r('stddev_samp(value)', 'sd')}, {_r('stddev_samp(value) / sqrt(count(value))', 'se')}, {_r('quantile_cont(value, 0.1)', 'q10')}, {_r('median(value)', 'median')}, {_r('quantile_cont(value, 0.9)', 'q90')}, {_r('avg((value > 50)::INT::DOUBLE)', 'rate')}, {_r('sum(value)', 'total')} FROM events GROUP BY 1",
    "interval_coverage": f"""WITH {_CURVES}, spans AS (SELECT event_type, min(hour) AS lo, max(hour) AS hi FROM c GROUP BY 1), s AS (SELECT event_type, unnest(range(lo, hi + 1, 12)) AS s FROM spans), w AS (SELECT DISTINCT event_type, s + unnest([-3, 0, 3]) AS a FROM s)
      SELECT w.event_type, a AS start, a + 24 AS "end", count(c.hour) AS samples, {_r('coalesce(avg(c.events), 0)', 'coverage')} FROM w LEFT JOIN c ON c.event_type = w.event_type AND c.hour >= a AND c.hour < a + 24 GROUP BY 1, 2, 3""",
    "common_overlap": f"""WITH u AS (SELECT event_type, user_id, min(epoch_us(ts)) / 1e6 AS a, max(epoch_us(ts)) / 1e6 AS b FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
      SELECT event_type, {_r('max(a)', 'start')}, {_r('min(b)', '"end"')}, {_r('greatest(0, min(b) - max(a))', 'length')} FROM u GROUP BY 1""",
    "json_issue_log": f"WITH {_RESPONSE_CELLS}, {_ISSUE_LOG} SELECT submission_row_id, path, code, field FROM log",
    "issue_counts": f"WITH {_RESPONSE_CELLS}, {_ISSUE_LOG} SELECT code, count(*) AS issues, count(DISTINCT submission_row_id) AS submissions FROM log GROUP BY 1",
    "greedy_separated_topk": "WITH c AS (SELECT * FROM (SELECT event_type AS grp, floor(epoch_us(ts) / 3600000000)::DOUBLE AS h, avg(value) AS score FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2) WHERE score IS NOT NULL), a0 AS (SELECT grp, h, score, 0 AS position FROM c WHERE false), "
    + ", ".join(f"a{k} AS (SELECT * FROM a{k - 1} UNION ALL SELECT * FROM (SELECT grp, h, score, {k} AS position FROM c WHERE NOT EXISTS (SELECT 1 FROM a{k - 1} a WHERE a.grp = c.grp AND abs(a.h - c.h) < 24) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, h) = 1))" for k in range(1, 6))
    + ' SELECT grp, round(h + 1e-10, 6) + 0.0 AS "at", round(score + 1e-10, 6) + 0.0 AS score, position FROM a5',
    "signal_fingerprints": "WITH b AS (SELECT feature_row_id, bark FROM features WHERE len(bark) = 48) SELECT feature_row_id, sha1(array_to_string(list_transform(range(0, 8), lambda k: printf('%.5f', sqrt(list_sum(list_transform(bark[k * 6 + 1 : k * 6 + 6], lambda v: v * v)) / 6))), ',')) AS fingerprint FROM b",
    "lag_correlation": f"WITH {_LAGS} SELECT lag, n, {_r('r', 'r')} FROM lags",
    "lag_estimate": f"""WITH {_LAGS}, b AS (SELECT lag AS best_lag, r AS best_r FROM lags ORDER BY r DESC, lag LIMIT 1), s AS (SELECT max(r) AS second_r FROM lags, b WHERE abs(lag - best_lag) > 1)
      SELECT best_lag, {_r('best_r', 'best_r')}, {_r('second_r', 'second_r')}, {_r('best_r - second_r', 'margin')}, second_r > 0.92 * best_r AS multimodal, {_r('least(1, greatest(0, 0.75 * best_r + 0.25 * least(1, greatest(0, (best_r - second_r) / 0.15))))', 'confidence')} FROM b, s""",
    "edge_grade": """WITH f AS (SELECT excerpt_id, abs(stereo_imbalance / 100) AS o, (stereo_width + 4) / 8 AS r FROM features WHERE excerpt_id IS NOT NULL AND stereo_imbalance IS NOT NULL AND NOT isnan(stereo_imbalance) AND stereo_width IS NOT NULL AND NOT isnan(stereo_width)),
      g AS (SELECT excerpt_id, CASE WHEN o <= 0.010 AND r >= 0.60 THEN 'PASS' WHEN o <= 0.030 AND r >= 0.35 THEN 'REVIEW' ELSE 'FAIL' END AS g FROM f)
      SELECT excerpt_id, CASE WHEN bool_or(g = 'FAIL') THEN 'FAIL' WHEN bool_or(g = 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS status, count(*) FILTER (WHERE g = 'PASS') AS passed, count(*) FILTER (WHERE g = 'REVIEW') AS review, count(*) FILTER (WHERE g = 'FAIL') AS failed FROM g GROUP BY 1""",
    "rolling_rise": f"WITH {_CURVES} SELECT event_type, hour, {_r('coalesce(greatest(0, value - lag(value) OVER (PARTITION BY event_type ORDER BY hour)), 0)', 'rise')} FROM c",
    "signal_levels": f"""WITH {_STEREO}, e AS (SELECT *, {_sum('l', 'v * v')} AS el, {_sum('r', 'v * v')} AS er, {_zip('(p[1] - p[2]) * (p[1] - p[2])')} AS side, {_zip('(p[1] + p[2]) * (p[1] + p[2])')} AS mid, list_max(list_transform(l, lambda v: abs(v))) AS peak FROM s)
      SELECT feature_row_id, {_r('sqrt(el / 24)', 'rms_left')}, {_r('sqrt(er / 24)', 'rms_right')}, {_r('20 * log10(greatest(peak, 1e-12) / greatest(sqrt(el / 24), 1e-12))', 'crest_left')}, {_r('CASE WHEN mid > 1e-12 THEN side / mid ELSE 0 END', 'width')}, {_r('CASE WHEN el + er > 1e-12 THEN (er - el) / (er + el) ELSE 0 END', 'imbalance')} FROM e""",
    "signal_shapes": f"""WITH {_STEREO}, x AS (SELECT feature_row_id, unnest(range(48))::INTEGER AS pos, unnest(bark) AS v FROM s), y AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd, v - lag(v) OVER (PARTITION BY feature_row_id ORDER BY pos) AS dv FROM x WINDOW w AS (PARTITION BY feature_row_id))
      SELECT feature_row_id, pos, {_r('CASE WHEN sd > 1e-12 THEN (v - m) / sd ELSE 0 END', 'z')}, {_r('coalesce(greatest(0, dv), 0)', 'rise')}, {_r('v * CASE WHEN pos < 4 THEN 0.5 - 0.5 * cos(pi() * (pos + 0.5) / 4) ELSE 1 END * CASE WHEN pos >= 44 THEN 0.5 - 0.5 * cos(pi() * (47 - pos + 0.5) / 4) ELSE 1 END', 'faded')} FROM y""",
    "flatten_json": """SELECT event_id, CASE WHEN json_valid(props) THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k,
      CASE WHEN coalesce(trim(props, ' '), '') = '' THEN 'missing_json' WHEN NOT json_valid(props) THEN 'malformed_json' WHEN try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'missing_key' ELSE 'ok' END AS state FROM events""",
    "trial_metadata": f"""WITH r AS (SELECT DISTINCT study_id, trial_index, display_position, coalesce(regexp_replace(trim(display_label, {_BL}), '^(?i:version)[ \\t]+', ''), '') AS label, {_KEY('stimulus_id')} AS stimulus, comparative_comment FROM responses_long
        WHERE coalesce(trim(study_id, ' '), '') <> '' AND trial_index IS NOT NULL AND display_position IS NOT NULL),
      o AS (SELECT study_id, trial_index, list_sort(list(DISTINCT {{'p': display_position, 'l': label}})) AS o, count(DISTINCT stimulus) AS stimuli, count(DISTINCT comparative_comment) AS comments FROM r GROUP BY 1, 2)
      SELECT study_id, trial_index, array_to_string(list_transform(o, lambda s: s.l), ' | ') AS display_order, len(o)::INTEGER AS labels, stimuli,
        concat_ws(';', CASE WHEN len(list_distinct(list_transform(o, lambda s: s.l))) < len(o) THEN 'duplicate_label' END, CASE WHEN comments > 1 THEN 'inconsistent_trial_comments' END, CASE WHEN len(o) <> 6 THEN 'unexpected_mix_count' END) AS notes FROM o""",
    "first_appearance": f"""WITH f AS (SELECT study_id, {_KEY('episode_id')} AS episode, min(trial_index) AS first_trial FROM responses_long WHERE coalesce(trim(study_id, ' '), '') <> '' AND trial_index IS NOT NULL AND {_KEY('episode_id')} IS NOT NULL GROUP BY 1, 2)
      SELECT *, (dense_rank() OVER (PARTITION BY study_id ORDER BY first_trial, episode))::INTEGER AS position FROM f""",
    "feature_quality_checks": " UNION ALL ".join(f"SELECT song_id, '{n}' AS \"check\", '{s}' AS severity, count(*) FILTER (WHERE {c}) AS failures, count(*) FILTER (WHERE {c}) = 0 AS passed FROM features GROUP BY 1" for n, s, c in _CHECKS),
    "repeated_vectors": "SELECT excerpt_id, feature_row_id, previous FROM (SELECT excerpt_id, feature_row_id, lag(feature_row_id) OVER (PARTITION BY excerpt_id, list_transform(bark, lambda v: round(v, 4)) ORDER BY feature_row_id) AS previous FROM features WHERE bark IS NOT NULL) WHERE previous IS NOT NULL",
    "ambiguous_mapping": f"SELECT {_KEY('stimulus_id')} AS stimulus, count(DISTINCT actual_mix_id) AS value_count FROM responses_long WHERE {_KEY('stimulus_id')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT actual_mix_id) > 1",
    "population_gaps": "SELECT mix_id, 'not_observed' AS gap FROM (SELECT mix_id FROM stimuli WHERE mix_id IS NOT NULL EXCEPT SELECT mix_id FROM evaluations) UNION ALL SELECT mix_id, 'not_expected' FROM (SELECT mix_id FROM evaluations WHERE mix_id IS NOT NULL EXCEPT SELECT mix_id FROM stimuli)",
    "compare_tolerance": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS compared, count(*) FILTER (WHERE abs(a - b) > 1e-8 + 1e-5 * abs(b)) AS beyond, {_r('max(abs(a - b))', 'greatest_abs_error')}, {_r('max(abs(a - b) / greatest(abs(b), 1e-12))', 'greatest_rel_error')}
        FROM (SELECT {c} AS a, {f}({c}, mean_pairwise_distance) AS b FROM (SELECT {', '.join(f'CASE WHEN NOT isnan({k}) THEN {k} END AS {k}' for k in (c, 'mean_pairwise_distance'))} FROM selection_method_comparison)) WHERE a IS NOT NULL AND b IS NOT NULL"""
        for c, f in (("minimum_pairwise_distance", "least"), ("maximum_pairwise_distance", "greatest"))
    ),
    "scenario_grid": f"SELECT scenario, {_r('scale', 'scale')}, participants, repetition::INTEGER AS repetition, (42 + 100000 * k + 100 * participants + repetition)::INTEGER AS run_seed FROM (VALUES ('moderate', 1.0::DOUBLE, 0), ('smaller', 0.6, 1), ('noisy', 1.0, 2)) s(scenario, scale, k), (SELECT unnest([20, 30, 40, 50, 60, 80]) AS participants) p, (SELECT unnest(range(1, 21)) AS repetition) r",
}
