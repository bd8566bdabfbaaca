"""Queries of session and order checks, the randomisation audit and report contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.text import is_blank
from tonelake.operators import design, sessions, signals, vectors
from tonelake.plans.excerpts import _ST, _stereo
from tonelake.plans.ratings import SCALARS, rounded
from tonelake.plans.vectors import _POOL, _edges, _pool
from tonelake.sources.records import rating_ok
from tonelake.sources.tables import table


def _identified(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "responses_long").where(~is_blank(F.col("study_id")) & F.col("trial_index").isNotNull())


def session_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks that every response and every trial of a session must pass."""
    rows = {"rating_readable": rating_ok(F.col("rating")), "rating_was_set": F.col("rating_set"), "audio_was_played": F.col("audio_played"), "stimulus_named": ~is_blank(F.col("stimulus_id")), "ended": F.col("completed_at") >= F.col("started_at"), "time_plausible": F.col("response_time_ms") >= 0}
    trials = {"six_labels": F.count_distinct("display_label") == 6, "six_positions": F.count_distinct("display_position") == 6, "stimuli_differ": F.count_distinct("stimulus_id") == F.count(F.lit(1)), "one_episode": F.count_distinct("episode_id") == 1, "one_song": F.count_distinct("song_id") == 1, "one_comment": F.count_distinct("comparative_comment") == 1}
    return sessions.session_checks(_identified(spark, d), "study_id", "trial_index", rows, trials, 6)


def order_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether a study's trials keep its episodes together, two songs each."""
    t = _identified(spark, d).groupBy("study_id", "trial_index").agg(F.min("episode_id").alias("episode_id"), F.min("song_id").alias("song_id"))
    return sessions.order_checks(t, "study_id", "trial_index", "episode_id", "song_id", 2)


def randomisation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Places of six labels in orders drawn for a thousand simulated participants of one trial."""
    items = spark.createDataFrame([(k,) for k in "ABCDEF"], "item string")
    drawn = design.blocked_order(spark.range(1000).select(F.col("id").cast("string").alias("unit"), F.lit("one").alias("block")).join(F.broadcast(items)), "unit", "block", "item", 7)
    return rounded(sessions.randomisation_audit(drawn, "item", "item_position"))


def screening_orders(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "submissions").where(~is_blank(F.col("study_id"))).select(F.col("study_id").alias("unit")).distinct()
    two = units.select("unit", F.explode(F.array(F.lit("easy"), F.lit("hard"))).alias("segment"))
    return sessions.ungrouped_order(two, "unit", "segment", 3, 20, 5)


def study_design(spark: SparkSession, d: str) -> DataFrame:
    """A design of 40 participants over the stimuli, songs in two groups by their name."""
    s = table(spark, d, "stimuli").where("song_id is not null and stimulus_id is not null").select("song_id", "stimulus_id", F.when(F.col("song_id") < "song_m", "first").otherwise("second").alias("grp"))
    return design.full_design(spark, 40, s, "grp", "song_id", "stimulus_id", ["EP-01", "EP-02", "EP-03"], 3)


def pair_separation(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of each pool from the least to the most separated, with the two scalars that differ most."""
    pool = _pool(spark, d)
    return rounded(sessions.separated_pairs(vectors.edges(pool, vectors.euclidean_of(len(SCALARS))), pool, SCALARS))


def report_context(spark: SparkSession, d: str) -> DataFrame:
    """Proposals per song and condition with the ratings, selections, features and stimuli of the song, and what they contradict each other in."""
    on = ["song_id"]
    p = table(spark, d, "six_mix_proposals").where("song_id is not null").groupBy("song_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("review_round").alias("rounds"), F.min("artist").alias("artist"), F.max("technical_qc_status").alias("worst"))
    tables = {
        "proposals": p, "ratings": table(spark, d, "evaluations").where("song_id is not null").groupBy("song_id").agg(F.count("preference_score_0_1").alias("scores"), F.count_distinct("mix_id").alias("mixes")),
        "selections": table(spark, d, "selection_method_comparison").where("song_id is not null").groupBy("song_id").agg(F.count(F.lit(1)).alias("sets"), F.min("artist").alias("artist")),
        "features": table(spark, d, "features").where("song_id is not null").groupBy("song_id").agg(F.count_distinct("mix_id").alias("mixes"), F.min("artist").alias("artist")),
        "stimuli": table(spark, d, "stimuli").where("song_id is not null").groupBy("song_id").agg(F.count_distinct("stimulus_id").alias("stimuli")),
    }
    return sessions.report_context(tables, on, {"artist_differs_in_selections": ("proposals_artist", "selections_artist"), "artist_differs_in_features": ("proposals_artist", "features_artist")}, {"proposals_worst": ["PASS", "REVIEW"]})


def spliced_signals(spark: SparkSession, d: str) -> DataFrame:
    """The left channel up to sample 10, then the right one, and the mono signal at -12 dB."""
    s = _stereo(spark, d)
    left, right = F.col("left"), F.col("right")
    got = s.select("feature_row_id", signals.spliced(left, right, F.lit(10), 4).alias("s"), signals.levelled(signals.mono(left, right), -12.0).alias("m"))
    return rounded(got.select("feature_row_id", F.posexplode(F.arrays_zip("s", "m")).alias("pos", "z")).select("feature_row_id", "pos", F.col("z.s").alias("spliced"), F.col("z.m").alias("levelled")))


def envelope_alignment(spark: SparkSession, d: str) -> DataFrame:
    """How the rises of the two channels align, 10 ms a step, graded."""
    s = _stereo(spark, d)
    a = signals.array_alignment(F.transform("left", F.abs), F.transform("right", F.abs), 3)
    got = s.select("feature_row_id", a.alias("a")).select("feature_row_id", "a.*")
    return rounded(got.withColumn("status", signals.grade(F.col("lag") * 0.01, F.col("r"))))


QUERIES = {f.__name__: f for f in (session_checks, order_checks, randomisation_audit, screening_orders, study_design, pair_separation, report_context, spliced_signals, envelope_alignment)}

_r = lambda e, n: f"round({e} + 1e-10, 6) + 0.0 AS {n}"
_ID = "coalesce(length(trim(study_id)), 0) > 0 AND trial_index IS NOT NULL"
_RATING = "coalesce(regexp_full_match(trim(rating, ' ' || chr(9)), '[0-9]{1,3}') AND try_cast(trim(rating, ' ' || chr(9)) AS INTEGER) <= 100, false)"
_ROWS = {"rating_readable": _RATING, "rating_was_set": "coalesce(rating_set, false)", "audio_was_played": "coalesce(audio_played, false)", "stimulus_named": "coalesce(trim(stimulus_id), '') <> ''", "ended": "coalesce(completed_at >= started_at, false)", "time_plausible": "coalesce(response_time_ms >= 0, false)"}
_TRIALS = {"six_labels": "count(DISTINCT display_label) = 6", "six_positions": "count(DISTINCT display_position) = 6", "stimuli_differ": "count(DISTINCT stimulus_id) = count(*)", "one_episode": "count(DISTINCT episode_id) = 1", "one_song": "count(DISTINCT song_id) = 1", "one_comment": "count(DISTINCT comparative_comment) = 1"}
_NAMES = [*_ROWS, *_TRIALS]
_GAP = ", ".join(f"{{'g': -round(abs(p.x[{k + 1}] - q.x[{k + 1}]), 9), 'p': {k}, 'n': '{c}'}}" for k, c in enumerate(SCALARS))
_MONO = "list_transform(range(1, 25), lambda k: (l[k] + r[k]) / 2)"

SQL = {
    "envelope_alignment": f"""WITH {_ST}, e AS (SELECT feature_row_id, list_transform(l, lambda v: abs(v)) AS x, list_transform(r, lambda v: abs(v)) AS y FROM ch), g AS (SELECT *, unnest(range(-3, 4))::INTEGER AS lag FROM e),
      p AS (SELECT feature_row_id, lag, unnest(x[greatest(0, -lag) + 1 : greatest(0, -lag) + 24 - abs(lag)]) AS u, unnest(y[greatest(0, lag) + 1 : greatest(0, lag) + 24 - abs(lag)]) AS v FROM g),
      c AS (SELECT feature_row_id, lag, round(CASE WHEN count(*) <= 4 OR var_pop(u) * count(*) <= 1e-12 OR var_pop(v) * count(*) <= 1e-12 THEN -1 ELSE corr(u, v) END, 9) AS r FROM p GROUP BY 1, 2),
      b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY feature_row_id ORDER BY r DESC, lag) = 1), s AS (SELECT c.feature_row_id, max(c.r) AS r2 FROM c JOIN b USING (feature_row_id) WHERE abs(c.lag - b.lag) > 1 GROUP BY 1)
      SELECT feature_row_id, lag, {_r('r', 'r')}, {_r('r2', 'second_r')}, {_r('greatest(0, least(1, 0.75 * r + 0.25 * greatest(0, least(1, (r - r2) / 0.15))))', 'confidence')},
        CASE WHEN abs(lag * 0.01) <= 0.010 AND r >= 0.60 THEN 'PASS' WHEN abs(lag * 0.01) <= 0.030 AND r >= 0.35 THEN 'REVIEW' ELSE 'FAIL' END AS status FROM b JOIN s USING (feature_row_id)""",
    "session_checks": f"""WITH t AS (SELECT study_id, trial_index, count(*) AS n, {', '.join(f'bool_and({c}) AS {n}' for n, c in _ROWS.items())}, {', '.join(f'{c} AS {n}' for n, c in _TRIALS.items())} FROM responses_long WHERE {_ID} GROUP BY 1, 2),
      s AS (SELECT study_id, count(*) AS trials, sum(n)::BIGINT AS responses, {', '.join(f'bool_and({n}) AS {n}' for n in _NAMES)}, count(*) = 6 AS trial_count FROM t GROUP BY 1) SELECT *, {' AND '.join([*_NAMES, 'trial_count'])} AS accepted FROM s""",
    "order_checks": f"""WITH t AS (SELECT study_id, trial_index, min(episode_id) AS e, min(song_id) AS s FROM responses_long WHERE {_ID} GROUP BY 1, 2), r AS (SELECT study_id, (lag(e) OVER w IS DISTINCT FROM e OR row_number() OVER w = 1 AND e IS NOT NULL)::INT AS new FROM t WINDOW w AS (PARTITION BY study_id ORDER BY trial_index)),
      k AS (SELECT study_id, sum(new) AS runs FROM r GROUP BY 1), b AS (SELECT study_id, e, count(*) AS n, count(DISTINCT s) AS i FROM t GROUP BY 1, 2), g AS (SELECT study_id, count(*) AS blocks, bool_and(n = 2) AS per_block, bool_and(n = i) AS items_once FROM b GROUP BY 1)
      SELECT study_id, blocks, runs = blocks AS contiguous, per_block, items_once FROM g JOIN k USING (study_id)""",
    "pair_separation": f"""WITH {_POOL}, {_edges()} SELECT e.grp, i, j, {_r('d', 'd')}, (row_number() OVER (PARTITION BY e.grp ORDER BY round(d, 9), i, j))::INTEGER AS rank, array_to_string(list_transform(list_sort([{_GAP}])[1:2], lambda s: s.n), ', ') AS differing
      FROM edges e JOIN pool p ON p.grp = e.grp AND p.idx = i JOIN pool q ON q.grp = e.grp AND q.idx = j""",
    "report_context": """WITH p AS (SELECT song_id, count(*) AS proposals_rows, count(DISTINCT review_round) AS proposals_rounds, min(artist) AS proposals_artist, max(technical_qc_status) AS proposals_worst FROM six_mix_proposals WHERE song_id IS NOT NULL GROUP BY 1),
      r AS (SELECT song_id, count(preference_score_0_1) AS ratings_scores, count(DISTINCT mix_id) AS ratings_mixes FROM evaluations WHERE song_id IS NOT NULL GROUP BY 1), s AS (SELECT song_id, count(*) AS selections_sets, min(artist) AS selections_artist FROM selection_method_comparison WHERE song_id IS NOT NULL GROUP BY 1),
      f AS (SELECT song_id, count(DISTINCT mix_id) AS features_mixes, min(artist) AS features_artist FROM features WHERE song_id IS NOT NULL GROUP BY 1), t AS (SELECT song_id, count(DISTINCT stimulus_id) AS stimuli_stimuli FROM stimuli WHERE song_id IS NOT NULL GROUP BY 1)
      SELECT p.*, r.* EXCLUDE (song_id), s.* EXCLUDE (song_id), f.* EXCLUDE (song_id), t.* EXCLUDE (song_id), array_to_string(list_filter([CASE WHEN r.song_id IS NULL THEN 'ratings_missing' END, CASE WHEN s.song_id IS NULL THEN 'selections_missing' END, CASE WHEN f.song_id IS NULL THEN 'features_missing' END, CASE WHEN t.song_id IS NULL THEN 'stimuli_missing' END,
        CASE WHEN proposals_artist IS DISTINCT FROM selections_artist THEN 'artist_differs_in_selections' END, CASE WHEN proposals_artist IS DISTINCT FROM features_artist THEN 'artist_differs_in_features' END, CASE WHEN proposals_worst NOT IN ('PASS', 'REVIEW') THEN 'proposals_worst_illegal' END], lambda x: x IS NOT NULL), ';') AS problems
      FROM p LEFT JOIN r USING (song_id) LEFT JOIN s USING (song_id) LEFT JOIN f USING (song_id) LEFT JOIN t USING (song_id)""",
    "spliced_signals": f"""WITH {_ST}, m AS (SELECT feature_row_id, l, r, {_MONO} AS mo FROM ch), g AS (SELECT *, list_max(list_transform(mo, lambda v: abs(v))) AS top, sqrt(list_sum(list_transform(mo, lambda v: v * v)) / 24) AS rms FROM m),
      h AS (SELECT *, least(pow(10, -0.6) / greatest(rms, 1e-12), 0.999 / greatest(top, 1e-12)) AS gain, unnest(range(24))::INTEGER AS pos FROM g)
      SELECT feature_row_id, pos, {_r('CASE WHEN pos < 10 THEN l[pos + 1] WHEN pos < 14 THEN l[pos + 1] * (1 - (pos - 9) / 5.0) + r[pos + 1] * ((pos - 9) / 5.0) ELSE r[pos + 1] END', 'spliced')}, {_r('CASE WHEN top > 1e-12 THEN mo[pos + 1] * gain ELSE mo[pos + 1] END', 'levelled')} FROM h""",
}
