"""Queries of excerpt choice and technical checks. Events stand for sources with hourly activity; spectra's halves for two channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import excerpts, signals
from tonelake.plans.ratings import rounded
from tonelake.sources.tables import table

GROUPS = ["bass", "drums", "other", "vocal"]
_SOURCES = {"view": "vocal", "click": "bass", "purchase": "drums", "signup": "other", "error": "other"}
LENGTH, HOP = 28.0, 12


def _activity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts is not null and event_type is not null")
    hour = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) - 473_352).cast("double")  # hours of 2024
    levels = e.groupBy("event_type", hour.alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("level"))
    return excerpts.active_rows(levels, "event_type", "level")


def activity_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _activity(spark, d)


def group_activity(spark: SparkSession, d: str) -> DataFrame:
    return excerpts.group_activity(_activity(spark, d), _SOURCES, "event_type", "hour")


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = group_activity(spark, d)
    ends = a.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    n = F.floor((F.col("hi") - F.col("lo") - LENGTH) / HOP).cast("int")
    candidates = ends.where(F.col("hi") - F.col("lo") >= LENGTH).select("lo", "hi", F.posexplode(F.transform(F.sequence(F.lit(0), n), lambda k: F.col("lo") + k * HOP)).alias("p", "s")).select("lo", "hi", (F.col("p") + 1).alias("candidate_rank"), "s")
    return excerpts.shifted(candidates, "s").where((F.col("start") >= F.col("lo")) & (F.col("start") + LENGTH <= F.col("hi"))).select("candidate_rank", "shift", "start"), a


def window_scores(spark: SparkSession, d: str) -> DataFrame:
    """Shifted windows with their coverage, boundary quality and source-aware and proxy scores, ranked."""
    w, a = _windows(spark, d)
    scored = excerpts.boundary_quality(excerpts.window_coverage(w, a, LENGTH, GROUPS, "hour"), a, LENGTH, GROUPS, "hour").withColumn("variation", F.abs(F.col("vocal") - F.col("bass")))
    scored = scored.withColumn("score", excerpts.window_score()).withColumn("proxy", excerpts.window_score(excerpts.PROXY_WEIGHTS))
    return rounded(excerpts.ranked_windows(scored, ["candidate_rank"]).select("candidate_rank", "shift", "start", *GROUPS, "core", "boundary", "score", "proxy", "position"))


def candidate_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 24 hours scored by the event types' curves."""
    a = _activity(spark, d)
    hours = a.select("hour").distinct().crossJoin(F.broadcast(a.select("event_type").distinct()))  # a handful of event types
    full = hours.join(a.select("event_type", "hour", "level"), ["event_type", "hour"], "left").na.fill(0.0, ["level"])
    curves = full.select(F.col("event_type").alias("item"), F.col("hour").alias("at"), F.log1p("level").alias("activity"), (F.col("level") % 3).alias("onset"), F.sqrt("level").alias("spectral"))
    return rounded(excerpts.candidate_windows(curves, 24.0, 1.0, 12.0))


def _stereo(spark: SparkSession, d: str) -> DataFrame:
    """The two halves of each 48-band vector as a left and a right channel, scaled to full scale 1."""
    scaled = F.transform("bark", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / 4)))
    f = table(spark, d, "features").where("size(bark) = 48 and not exists(bark, v -> v is null or isnan(v))")
    return f.select("feature_row_id", "excerpt_id", "mix_id", "stereo_imbalance", scaled.alias("s")).withColumn("left", F.slice("s", 1, 24)).withColumn("right", F.slice("s", 25, 24))


def technical_qc(spark: SparkSession, d: str) -> DataFrame:
    got = excerpts.technical_checks(_stereo(spark, d), "left", "right", F.abs("stereo_imbalance") >= 4, F.lit(True))
    return rounded(got.select("feature_row_id", "peak", "clipped", "near_clipped", "channel_gap_db", "phase", "mono_duplicate", "reasons", "status"))


def signal_probe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_stereo(spark, d).select("feature_row_id", excerpts.probe(F.col("left")).alias("p")).select("feature_row_id", "p.*"))


def boundary_clicks(spark: SparkSession, d: str) -> DataFrame:
    s = _stereo(spark, d)
    a = F.col("left")
    got = s.select("feature_row_id", excerpts.discontinuity(a, 4).alias("at_start"), excerpts.discontinuity(a, 4, False).alias("at_end"), excerpts.click_check(a, 4, 0.5).alias("result"), excerpts.click_check(excerpts.linear_faded(a, 6), 4, 0.5).alias("faded_result"))
    return rounded(got)


def excerpt_slices(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen samples from a place that depends on the row, or why they cannot be cut."""
    s = _stereo(spark, d).withColumn("place", (F.col("feature_row_id") % 12 - 2).cast("int"))
    cut = excerpts.excerpt(F.col("left"), F.col("place"), 16)
    return rounded(s.select("feature_row_id", "place", F.size(cut).alias("samples"), F.element_at(cut, 1).alias("first_sample"), excerpts.excerpt_error(F.col("left"), F.col("place"), 16).alias("error")))


def active_shares(spark: SparkSession, d: str) -> DataFrame:
    curve = excerpts.active_curve(F.transform("left", F.abs))
    return rounded(_stereo(spark, d).select("feature_row_id", F.aggregate(curve, F.lit(0.0), lambda s, v: s + v).alias("active"), excerpts.quantile(F.transform("left", F.abs), 0.7).alias("p70")))


def cross_item_variation(spark: SparkSession, d: str) -> DataFrame:
    s = _stereo(spark, d).select("excerpt_id", "mix_id", F.log(F.greatest(signals.rms(F.col("left")), F.lit(1e-9))).alias("level"), signals.crest_db(F.col("left")).alias("crest"), signals.stereo_width(F.col("left"), F.col("right")).alias("width")).where("excerpt_id is not null")
    return rounded(excerpts.variation(s, ["excerpt_id"], ["level", "crest", "width"]))


def strongest_peaks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(excerpts.strongest_peaks(_activity(spark, d), "event_type", "hour", "level", 8))


def alignment_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Largest offset, least correlation and worst status of the proposals of each set."""
    p = table(spark, d, "six_mix_proposals").where("six_mix_set_id is not null")
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(c) < 1e6), F.col(c))
    rows = p.select("six_mix_set_id", ok("stereo_imbalance").alias("offset_ms"), ok("distance_from_acoustic_medoid").alias("r"), ok("nearest_neighbour_distance").alias("confidence"), "alignment_status")
    return rounded(excerpts.alignment_rollup(rows, ["six_mix_set_id"], "offset_ms", "r", "confidence", "alignment_status"))


QUERIES = {f.__name__: f for f in (activity_by_source, group_activity, window_scores, candidate_windows, technical_qc, signal_probe, boundary_clicks, excerpt_slices, active_shares, cross_item_variation, strongest_peaks, alignment_rollup)}

_r = lambda e, n: f"round({e} + 1e-10, 6) + 0.0 AS {n}"
_ACT = """lv AS (SELECT event_type, floor(epoch_us(ts) / 3600000000) - 473352 AS hour, count(*)::DOUBLE AS level FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
q AS (SELECT event_type, quantile_cont(level, 0.2) AS lo, quantile_cont(level, 0.7) AS hi FROM lv GROUP BY 1),
act AS (SELECT lv.event_type, hour, level, (level > lo + 0.2 * greatest(hi - lo, 1e-9))::INT::DOUBLE AS active FROM lv JOIN q USING (event_type))"""
_GRP = _ACT + """, ga AS (SELECT hour, coalesce(max(active) FILTER (WHERE event_type = 'click'), 0) AS bass, coalesce(max(active) FILTER (WHERE event_type = 'purchase'), 0) AS drums,
  coalesce(max(active) FILTER (WHERE event_type IN ('signup', 'error')), 0) AS other, coalesce(max(active) FILTER (WHERE event_type = 'view'), 0) AS vocal FROM act GROUP BY 1)"""
_ST = """st AS (SELECT feature_row_id, excerpt_id, mix_id, stereo_imbalance, list_transform(bark, lambda v: greatest(-1.0, least(1.0, v / 4))) AS s FROM features WHERE len(bark) = 48 AND len(list_filter(bark, lambda v: v IS NULL OR isnan(v))) = 0),
ch AS (SELECT *, s[1:24] AS l, s[25:48] AS r FROM st)"""
_RMS = lambda c: f"sqrt(list_sum(list_transform({c}, lambda v: v * v)) / len({c}))"
_LEVEL = lambda c: f"20 * log10(greatest(sqrt(list_sum(list_transform({c}, lambda v: v * v)) / 24 + 1e-12), 1e-12))"
_STEP = lambda c, a, b: f"list_max(list_transform(range({a}, {b}), lambda k: abs({c}[k + 1] - {c}[k])))"

SQL = {
    "activity_by_source": f"WITH {_ACT} SELECT event_type, hour, level, active FROM act",
    "group_activity": f"WITH {_GRP} SELECT hour, bass, drums, other, vocal FROM ga",
    "window_scores": f"""WITH {_GRP}, ends AS (SELECT min(hour) AS lo, max(hour) AS hi FROM ga), c AS (SELECT lo, hi, unnest(range(0, floor((hi - lo - 28) / 12)::INT + 1)) AS k FROM ends WHERE hi - lo >= 28),
      w AS (SELECT (k + 1)::INTEGER AS candidate_rank, h * 0.5 AS shift, round(lo + k * 12 + h * 0.5, 6) AS start FROM c, (SELECT unnest(range(-6, 7)) AS h) WHERE lo + k * 12 + h * 0.5 >= lo AND lo + k * 12 + h * 0.5 + 28 <= hi),
      st AS (SELECT DISTINCT start FROM w), cov AS (SELECT start, avg(bass) AS bass, avg(drums) AS drums, avg(other) AS other, avg(vocal) AS vocal, avg(vocal * bass * drums) AS core FROM st JOIN ga ON hour >= start AND hour < start + 28 GROUP BY 1),
      ed AS (SELECT DISTINCT unnest([start, start + 28]) AS edge FROM st),
      q1 AS (SELECT edge, avg((bass + drums + other + vocal > 0)::INT) FILTER (WHERE hour <= edge + 0.75) AS near, avg((bass + drums + other + vocal > 0)::INT) FILTER (WHERE hour >= edge + 0.75) AS inn FROM ed JOIN ga ON hour >= edge - 0.75 AND hour <= edge + 2 GROUP BY 1),
      q2 AS (SELECT edge, CASE WHEN near IS NULL THEN 1 ELSE greatest(0, least(1, 1 - 0.35 * abs(near - coalesce(inn, near)))) END AS q FROM q1),
      b AS (SELECT st.start, coalesce(x.q, 1) * coalesce(y.q, 1) AS boundary FROM st LEFT JOIN q2 x ON x.edge = st.start LEFT JOIN q2 y ON y.edge = st.start + 28),
      z AS (SELECT candidate_rank, shift, w.start, coalesce(bass, 0) AS bass, coalesce(drums, 0) AS drums, coalesce(other, 0) AS other, coalesce(vocal, 0) AS vocal, coalesce(core, 0) AS core, boundary FROM w JOIN b USING (start) LEFT JOIN cov USING (start)),
      s AS (SELECT *, abs(vocal - bass) AS variation, 0.24 * vocal + 0.18 * bass + 0.20 * drums + 0.10 * other + 0.16 * core + 0.07 * abs(vocal - bass) + 0.05 * boundary AS score,
        0.20 * vocal + 0.18 * bass + 0.18 * drums + 0.12 * other + 0.12 * core + 0.10 * abs(vocal - bass) + 0.10 * boundary AS proxy FROM z)
      SELECT candidate_rank, {_r('shift', 'shift')}, {_r('start', '"start"')}, {_r('bass', 'bass')}, {_r('drums', 'drums')}, {_r('other', 'other')}, {_r('vocal', 'vocal')}, {_r('core', 'core')}, {_r('boundary', 'boundary')}, {_r('score', 'score')}, {_r('proxy', 'proxy')},
        (row_number() OVER (PARTITION BY candidate_rank ORDER BY round(score, 9) DESC, round(boundary, 9) DESC, round(core, 9) DESC, round(vocal + bass + drums, 9) DESC, round(variation, 9) DESC, start))::INTEGER AS position FROM s""",
    "candidate_windows": f"""WITH {_ACT}, h AS (SELECT DISTINCT hour FROM lv), t AS (SELECT DISTINCT event_type FROM lv), f AS (SELECT event_type, hour, coalesce(level, 0) AS level FROM h CROSS JOIN t LEFT JOIN lv USING (event_type, hour)),
      cu AS (SELECT event_type, hour, ln(1 + level) AS activity, level % 3 AS onset, sqrt(level) AS spectral FROM f), e AS (SELECT min(hour) AS lo, max(hour) + 1 AS hi FROM cu),
      p AS (SELECT *, CASE WHEN hi - 36 >= lo + 12 THEN lo + 12 ELSE lo END AS a, CASE WHEN hi - 36 >= lo + 12 THEN hi - 36 ELSE hi - 24 END AS b FROM e),
      w AS (SELECT lo, hi, a + unnest(range(0, floor(b - a + 1e-6)::INT + 1)) AS start FROM p WHERE b >= a), hit AS (SELECT w.*, cu.* FROM w JOIN cu ON hour >= start AND hour < start + 24),
      sp AS (SELECT start, avg(sd) AS sd, count(*) AS bins FROM (SELECT start, hour, stddev_pop(activity) AS sd FROM hit GROUP BY 1, 2) GROUP BY 1),
      m AS (SELECT start, lo, hi, avg(activity) AS activity, avg(onset) AS onset, avg(spectral) AS spectral, quantile_cont(greatest(0, activity), 0.2) AS lim FROM hit GROUP BY 1, 2, 3),
      si AS (SELECT start, avg((greatest(0, hit.activity) < lim)::INT) AS silence FROM hit JOIN m USING (start) GROUP BY 1),
      o AS (SELECT m.*, bins, 1 / (1 + sd) AS consistency, silence, greatest(0, 1 - least(start - lo, hi - start - 24) / 12) AS boundary FROM m JOIN sp USING (start) JOIN si USING (start) WHERE bins >= 0.95 * 24)
      SELECT {_r('start', '"start"')}, bins, {_r('activity', 'activity')}, {_r('onset', 'onset')}, {_r('spectral', 'spectral')}, {_r('consistency', 'consistency')}, {_r('silence', 'silence')}, {_r('boundary', 'boundary')},
        {_r('activity + 0.55 * onset + 0.45 * spectral + 0.75 * consistency - 0.6 * silence - 0.4 * boundary', 'score')} FROM o""",
    "technical_qc": f"""WITH {_ST}, a AS (SELECT *, list_max(list_transform(s, lambda v: abs(v))) AS peak, len(list_filter(s, lambda v: abs(v) >= 1))::INTEGER AS clipped, len(list_filter(s, lambda v: abs(v) >= 0.98))::INTEGER AS near_clipped, abs({_LEVEL('l')} - {_LEVEL('r')}) AS gap,
        list_avg(l) AS ml, list_avg(r) AS mr FROM ch),
      b AS (SELECT *, list_sum(list_transform(l, lambda v: (v - ml) ** 2)) AS ll, list_sum(list_transform(r, lambda v: (v - mr) ** 2)) AS rr, list_sum(list_transform(range(1, 25), lambda k: (l[k] - ml) * (r[k] - mr))) AS lr, list_max(list_transform(range(1, 25), lambda k: abs(l[k] - r[k]))) AS dif FROM a),
      c AS (SELECT *, CASE WHEN ll > 24e-18 AND rr > 24e-18 THEN lr / sqrt(ll * rr) ELSE 0 END AS phase FROM b), d AS (SELECT *, phase > 0.9999 AND dif < 1e-4 AS mono FROM c),
      e AS (SELECT *, array_to_string(list_filter([CASE WHEN abs(stereo_imbalance) >= 4 THEN 'stereo_imbalance_qc_flag' END, CASE WHEN clipped > 0 THEN 'FAIL_clipping' END, CASE WHEN near_clipped > 0 THEN 'near_clipped_samples' END,
        CASE WHEN gap > 6 THEN 'severe_channel_energy_difference' END, CASE WHEN mono THEN 'mono_duplicate_channels' END, CASE WHEN abs(phase) < 0.05 THEN 'phase_correlation_review' END], lambda x: x IS NOT NULL), ';') AS reasons FROM d)
      SELECT feature_row_id, {_r('peak', 'peak')}, clipped, near_clipped, {_r('gap', 'channel_gap_db')}, {_r('phase', 'phase')}, mono AS mono_duplicate, reasons, CASE WHEN reasons LIKE '%FAIL%' THEN 'FAIL' WHEN reasons = '' THEN 'PASS' ELSE 'REVIEW' END AS status FROM e""",
    "signal_probe": f"WITH {_ST}, p AS (SELECT feature_row_id, list_max(list_transform(l, lambda v: abs(v))) AS peak, {_RMS('l')} AS rms FROM ch) SELECT feature_row_id, true AS readable, true AS finite, {_r('peak', 'peak')}, {_r('rms', 'rms')}, peak < 1e-5 AS near_silent, peak >= 0.999 AS clipping FROM p",
    "boundary_clicks": f"""WITH {_ST}, f AS (SELECT *, list_transform(range(1, 25), lambda k: l[k] * (CASE WHEN k - 1 < 6 THEN (k - 1) / 6.0 ELSE 1 END) * (CASE WHEN 24 - k < 6 THEN (24 - k) / 6.0 ELSE 1 END)) AS fl FROM ch),
      s AS (SELECT feature_row_id, {_STEP('l', 1, 6)} AS a, {_STEP('l', 19, 24)} AS b, {_STEP('fl', 1, 6)} AS fa, {_STEP('fl', 19, 24)} AS fb FROM f)
      SELECT feature_row_id, {_r('a', 'at_start')}, {_r('b', 'at_end')}, CASE WHEN a <= 0.5 AND b <= 0.5 THEN 'pass' ELSE 'fail' END AS result, CASE WHEN fa <= 0.5 AND fb <= 0.5 THEN 'pass' ELSE 'fail' END AS faded_result FROM s""",
    "excerpt_slices": f"""WITH {_ST}, p AS (SELECT *, (feature_row_id % 12 - 2)::INTEGER AS place FROM ch) SELECT feature_row_id, place, CASE WHEN place >= 0 AND place + 16 <= 24 THEN 16 END AS samples, {_r("CASE WHEN place >= 0 AND place + 16 <= 24 THEN l[place + 1] END", 'first_sample')},
      CASE WHEN place < 0 THEN 'starts_before_signal' WHEN place + 16 > 24 THEN 'ends_after_signal' END AS error FROM p""",
    "active_shares": f"""WITH {_ST}, a AS (SELECT feature_row_id, list_transform(l, lambda v: abs(v)) AS x FROM ch), q AS (SELECT feature_row_id, x, quantile_cont(v, 0.2) AS lo, quantile_cont(v, 0.7) AS hi FROM (SELECT *, unnest(x) AS v FROM a) GROUP BY 1, 2)
      SELECT feature_row_id, {_r("len(list_filter(x, lambda v: v > lo + 0.2 * greatest(hi - lo, 1e-9)))::DOUBLE", 'active')}, {_r('hi', 'p70')} FROM q""",
    "cross_item_variation": f"""WITH {_ST}, d AS (SELECT excerpt_id, ln(greatest({_RMS('l')}, 1e-9)) AS a, 20 * log10(greatest(list_max(list_transform(l, lambda v: abs(v))), 1e-12) / greatest({_RMS('l')}, 1e-12)) AS b,
        CASE WHEN list_sum(list_transform(range(1, 25), lambda k: (l[k] + r[k]) ** 2)) > 1e-12 THEN list_sum(list_transform(range(1, 25), lambda k: (l[k] - r[k]) ** 2)) / list_sum(list_transform(range(1, 25), lambda k: (l[k] + r[k]) ** 2)) ELSE 0 END AS w FROM ch WHERE excerpt_id IS NOT NULL)
      SELECT excerpt_id, {_r("CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0, least(1, 8 * (stddev_pop(a) / (avg(abs(a)) + 1e-6) + stddev_pop(b) / (avg(abs(b)) + 1e-6) + stddev_pop(w) / (avg(abs(w)) + 1e-6)) / 3)) END", 'variation')} FROM d GROUP BY 1""",
    "strongest_peaks": f"""WITH {_ACT}, n AS (SELECT *, lag(level) OVER w AS p, lead(level) OVER w AS nx FROM act WINDOW w AS (PARTITION BY event_type ORDER BY hour)), t AS (SELECT * FROM n WHERE level > p AND level >= nx QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY level DESC, hour) <= 8)
      SELECT event_type, {_r('hour', 'hour')}, {_r('level', 'level')}, (row_number() OVER (PARTITION BY event_type ORDER BY hour))::INTEGER AS position FROM t""",
    "alignment_rollup": f"""WITH p AS (SELECT six_mix_set_id, alignment_status, {', '.join(f"CASE WHEN NOT isnan({c}) AND abs({c}) < 1e6 THEN {c} END AS {n}" for c, n in (('stereo_imbalance', 'o'), ('distance_from_acoustic_medoid', 'r'), ('nearest_neighbour_distance', 'k')))} FROM six_mix_proposals WHERE six_mix_set_id IS NOT NULL)
      SELECT six_mix_set_id, {_r('max(abs(o))', 'largest_offset_ms')}, {_r('min(r)', 'least_r')}, {_r('min(k)', 'confidence')}, CASE max(CASE alignment_status WHEN 'FAIL' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'REVIEW' ELSE 'PASS' END AS status FROM p GROUP BY 1""",
}
