"""Choosing excerpts of time lines: activity, window scores, boundaries, and technical checks of stereo signals.

Activity curves are rows (source, at, active); windows meet the samples of their time buckets only (operators/signals).
Signals are arrays in a row; their checks are array expressions.

Defined results: a window without samples has coverage 0 and, at its boundaries, quality 1; variation of fewer than two
items is 0; a constant channel has phase correlation 0; an empty signal has level 0 and no clipped sample; a null signal
gives nulls; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions.numeric import bound
from tonelake.operators import signals

# fixed values: weights of the source-aware score, and of the proxy without source activity
SOURCE_WEIGHTS = {"vocal": 0.24, "bass": 0.18, "drums": 0.20, "other": 0.10, "core": 0.16, "variation": 0.07, "boundary": 0.05}
PROXY_WEIGHTS = {"vocal": 0.20, "bass": 0.18, "drums": 0.18, "other": 0.12, "core": 0.12, "variation": 0.10, "boundary": 0.10}
CORE = ("vocal", "bass", "drums")


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def quantile(a: Column, p: float) -> Column:
    """Linear quantile of an array's values."""

    def at(s: Column) -> Column:
        where = (F.size(s) - 1) * F.lit(p)
        low = F.floor(where).cast("int")
        here, there = F.element_at(s, low + 1), F.element_at(s, F.least(low + 2, F.size(s)))
        return F.when(F.size(s) > 0, here + (there - here) * (where - low))

    return bound(F.array_sort(a), at)


def active_curve(a: Column) -> Column:
    """1 where the envelope lies above p20 + .2 (p70 - p20), else 0."""
    limit = lambda lo, hi: lo + 0.2 * F.greatest(hi - lo, F.lit(1e-9))
    return bound(F.struct(quantile(a, 0.2).alias("lo"), quantile(a, 0.7).alias("hi")), lambda q: F.transform(a, lambda v: F.when(v > limit(q["lo"], q["hi"]), 1.0).otherwise(0.0)))


def active_rows(df: DataFrame, source: str, level: str) -> DataFrame:
    """Adds `active` (0 or 1) by each source's own p20 + .2 (p70 - p20)."""
    q = df.groupBy(source).agg(F.percentile(level, F.array(F.lit(0.2), F.lit(0.7))).alias("_q"))
    limit = F.col("_q")[0] + 0.2 * F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1e-9))
    return df.join(q, source).withColumn("active", (F.col(level) > limit).cast("double")).drop("_q")


def group_activity(df: DataFrame, sources: dict[str, str], source: str, at: str) -> DataFrame:
    """(at, vocal, bass, ...): the greatest activity of each group's sources per time; `sources` maps a source to its group. Times with no source of a group have 0 there."""
    group = F.create_map(*(F.lit(x) for pair in sources.items() for x in pair))[F.col(source)]
    names = sorted(set(sources.values()))
    return df.withColumn("_g", group).groupBy(at).agg(*(F.coalesce(F.max(F.when(F.col("_g") == n, F.col("active"))), F.lit(0.0)).alias(n) for n in names))


def shifted(windows: DataFrame, start: str, most: float = 3.0, step: float = 0.5) -> DataFrame:
    """Each window at shifts from -most to most."""
    n = round(most / step)
    return windows.select("*", F.explode(F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda k: k * F.lit(step))).alias("shift")).withColumn("start", F.round(F.col(start) + F.col("shift"), 6))


def window_coverage(windows: DataFrame, activity: DataFrame, length: float, groups: list[str], at: str = "at") -> DataFrame:
    """Adds each group's mean activity within start <= t < start + length, and `core`, the mean product of the core groups."""
    core = F.lit(1.0)
    for c in CORE:
        core = core * F.col(c)
    samples = activity.select(F.lit(1).alias("_one"), F.col(at).alias("_at"), *groups, core.alias("core"))
    # windows of one start share their samples
    starts = windows.select("start").distinct().withColumn("_one", F.lit(1)).withColumn("_end", F.col("start") + length)
    hit = signals.window_join(starts, samples, "_one", "start", "_end", "_at", length)
    means = hit.groupBy("start").agg(*(F.avg(c).alias(c) for c in (*groups, "core")))
    return windows.join(means, "start", "left").na.fill(0.0, [*groups, "core"])


def boundary_quality(windows: DataFrame, activity: DataFrame, length: float, groups: list[str], at: str = "at", near: float = 0.75, inner: float = 2.0) -> DataFrame:
    """Adds `boundary`: the product over both edges of 1 - .35 |share active near the edge - share active after it|, within 0..1.

    Near is within `near` of the edge, after is from `near` to `inner` behind it; where nothing lies after, the near share stands in; an edge without samples counts 1.
    """
    total = F.lit(0.0)
    for g in groups:
        total = total + F.col(g)
    samples = activity.select(F.lit(1).alias("_one"), F.col(at).alias("_at"), (total > 0).cast("double").alias("_on"))
    edges = windows.select(F.explode(F.array("start", F.col("start") + length)).alias("edge")).distinct().withColumn("_one", F.lit(1)).withColumn("_s", F.col("edge") - near).withColumn("_e", F.col("edge") + inner + 1e-9)
    hit = signals.window_join(edges, samples, "_one", "_s", "_e", "_at", inner + near)
    gap = F.col("_at") - F.col("edge")
    share = hit.groupBy("edge").agg(F.avg(F.when(gap <= near, F.col("_on"))).alias("_near"), F.avg(F.when(gap >= near, F.col("_on"))).alias("_inner"))
    q = share.select("edge", F.when(F.col("_near").isNull(), 1.0).otherwise(clamp(1 - 0.35 * F.abs(F.col("_near") - F.coalesce("_inner", "_near")))).alias("q"))
    one = windows.select("start").distinct().select("start", F.explode(F.array("start", F.col("start") + length)).alias("edge")).join(q, "edge", "left").groupBy("start").agg(F.product(F.coalesce("q", F.lit(1.0))).alias("boundary"))
    return windows.join(one, "start")


def variation(items: DataFrame, by: list[str], descriptors: list[str], factor: float = 8.0) -> DataFrame:
    """(*by, variation): the mean over descriptors of their population deviation over their mean size, times `factor`, within 0..1; 0 below two items."""
    cov = [F.stddev_pop(c) / (F.avg(F.abs(F.col(c))) + 1e-6) for c in descriptors]
    mean = sum(cov[1:], cov[0]) / len(cov)
    return items.groupBy(*by).agg(F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(clamp(mean * factor)).alias("variation"))


def window_score(weights: dict[str, float] = SOURCE_WEIGHTS) -> Column:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.col(c)
    return total


def decision_confidence(score: Column, source_alignment: Column, least_alignment: Column) -> Column:
    return clamp(0.65 * score + 0.20 * source_alignment + 0.15 * least_alignment)


def ranked_windows(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds `position` by score, boundary, core, the sum of the core groups and variation, all descending, then the candidate's rank."""
    order = [F.desc(F.round(c, 9)) for c in ("score", "boundary", "core")] + [F.desc(F.round(F.col("vocal") + F.col("bass") + F.col("drums"), 9)), F.desc(F.round("variation", 9)), F.asc("candidate_rank"), F.asc("start")]
    return df.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def candidate_score(activity: Column, onset: Column, spectral: Column, consistency: Column, silence: Column, boundary: Column) -> Column:
    return activity + 0.55 * onset + 0.45 * spectral + 0.75 * consistency - 0.6 * silence - 0.4 * boundary


def candidate_windows(curves: DataFrame, length: float, hop: float, avoid: float, least_share: float = 0.95, quiet: float = 0.2) -> DataFrame:
    """Scored windows of `length` every `hop`: curves are (item, at, activity, onset, spectral), one row per item and bin.

    Windows keep `avoid` from both ends where there is room, and need `least_share` of their bins. Consistency is
    1 / (1 + the mean over time of the items' deviation); silence the share of cells below the window's `quiet` quantile
    of activity; the boundary penalty falls from 1 at an end to 0 at `avoid`.
    """
    ends = curves.agg(F.min("at").alias("lo"), (F.max("at") + hop).alias("hi"))
    room = F.col("hi") - avoid - length >= F.col("lo") + avoid
    first, last = F.when(room, F.col("lo") + avoid).otherwise(F.col("lo")), F.when(room, F.col("hi") - avoid - length).otherwise(F.col("hi") - length)
    starts = ends.withColumn("_f", first).withColumn("_l", last).where("_l >= _f").select("lo", "hi", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("_l") - F.col("_f")) / hop + 1e-6).cast("int")), lambda k: F.col("_f") + k * F.lit(hop))).alias("start"))
    w = starts.withColumn("_one", F.lit(1)).withColumn("_end", F.col("start") + length)
    samples = curves.select(F.lit(1).alias("_one"), F.col("at").alias("_at"), "item", F.greatest(F.lit(0.0), F.col("activity")).alias("raw"), "activity", "onset", "spectral")
    hit = signals.window_join(w, samples, "_one", "start", "_end", "_at", length)
    spread = hit.groupBy("start", "_at").agg(F.stddev_pop("activity").alias("sd")).groupBy("start").agg(F.avg("sd").alias("sd"), F.count(F.lit(1)).alias("bins"))
    means = hit.groupBy("start", "lo", "hi").agg(F.avg("activity").alias("activity"), F.avg("onset").alias("onset"), F.avg("spectral").alias("spectral"), F.percentile("raw", F.lit(quiet)).alias("limit"))
    still = hit.select("start", "raw").join(means.select("start", "limit"), "start").groupBy("start").agg(F.avg((F.col("raw") < F.col("limit")).cast("double")).alias("silence"))
    out = means.join(spread, "start").join(still, "start").where(F.col("bins") >= F.lit(least_share * round(length / hop)))
    near = F.least(F.col("start") - F.col("lo"), F.col("hi") - F.col("start") - length)
    out = out.withColumn("consistency", 1 / (1 + F.col("sd"))).withColumn("boundary", F.greatest(F.lit(0.0), 1 - near / max(avoid, 1.0)))
    return out.select("start", "bins", "activity", "onset", "spectral", "consistency", "silence", "boundary", candidate_score(*(F.col(c) for c in ("activity", "onset", "spectral", "consistency", "silence", "boundary"))).alias("score"))


# stereo signals

def excerpt(a: Column, start: Column, length: int) -> Column:
    """`length` samples from `start` on; null where they do not all exist."""
    return F.when((start >= 0) & (start + length <= F.size(a)), F.slice(a, start.cast("int") + 1, F.lit(length)))


def excerpt_error(a: Column, start: Column, length: int) -> Column:
    """Why an excerpt cannot be cut, or null."""
    return F.when(a.isNull(), "no_signal").when(start < 0, "starts_before_signal").when(start + length > F.size(a), "ends_after_signal")


def aligned_to_source(start: Column, end: Column, lag: Column, rate: int) -> tuple[Column, Column]:
    """An aligned interval in a source's own samples."""
    return F.round((start + lag) * rate).cast("bigint"), F.round((end + lag) * rate).cast("bigint")


def discontinuity(a: Column, window: int, at_start: bool = True) -> Column:
    """Greatest step between neighbours within `window` of an end; 0 below two samples."""
    n = F.size(a)
    size = F.least(n, F.lit(max(window + 2, 2)))
    part = F.slice(a, F.lit(1), size) if at_start else F.slice(a, F.greatest(F.lit(1), n - size + 1), size)
    steps = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda x, y: F.abs(y - x))
    return F.when(n < 2, F.lit(0.0)).otherwise(bound(part, lambda p: F.array_max(steps(p))))


def click_check(a: Column, window: int, limit: float) -> Column:
    return F.when((discontinuity(a, window) <= limit) & (discontinuity(a, window, False) <= limit), "pass").otherwise("fail")


def linear_faded(a: Column, samples: int, most: int | None = None) -> Column:
    """Linear fades over `samples` at each end, at most `most` and half the signal."""
    k = F.least(F.lit(samples if most is None else min(samples, most)), F.floor(F.size(a) / 2).cast("int"))
    ramp = lambda i: F.when(i < k, i / F.greatest(k, F.lit(1))).otherwise(1.0)
    return F.transform(a, lambda v, i: v * ramp(i) * ramp(F.size(a) - 1 - i))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def phase_correlation(left: Column, right: Column) -> Column:
    """Correlation of the channels; 0 where one is constant."""

    def corr(m: Column) -> Column:
        dev = lambda a, mean: F.transform(a, lambda v: v - mean)
        return bound(F.struct(dev(left, m["l"]).alias("l"), dev(right, m["r"]).alias("r")), of)

    def of(d: Column) -> Column:
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        ll, rr = dot(d["l"], d["l"]), dot(d["r"], d["r"])
        floor = F.size(d["l"]) * F.lit(1e-18)
        return F.when((ll > floor) & (rr > floor), dot(d["l"], d["r"]) / F.sqrt(ll * rr)).otherwise(0.0)

    return bound(F.struct(_mean(left).alias("l"), _mean(right).alias("r")), corr)


def level_db(a: Column) -> Column:
    return 20 * F.log10(F.greatest(F.sqrt(_mean(F.transform(a, lambda v: v * v)) + 1e-12), F.lit(1e-12)))


def technical_checks(df: DataFrame, left: str, right: str, flagged: Column, normalised: Column) -> DataFrame:
    """Adds peak, clipped, near_clipped, channel_gap_db, phase, mono_duplicate, reasons (joined by `;`) and status of stereo signals.

    `flagged` tells an imbalance under review, `normalised` whether loudness normalisation passed. Clipping fails; any other reason means review.
    """
    a, b = F.col(left), F.col(right)
    both = F.concat(a, b)
    count = lambda limit: F.size(F.filter(F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x), F.abs(y))), lambda v: v >= limit))
    samples = lambda limit: F.size(F.filter(both, lambda v: F.abs(v) >= limit))
    out = df.withColumn("peak", F.array_max(F.transform(both, F.abs))).withColumn("clipped", samples(1.0)).withColumn("near_clipped", samples(0.98)).withColumn("clipped_frames", count(1.0))
    out = out.withColumn("channel_gap_db", F.abs(level_db(a) - level_db(b))).withColumn("phase", phase_correlation(a, b))
    gap = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    out = out.withColumn("mono_duplicate", (F.col("phase") > 0.9999) & (gap < 1e-4))
    reasons = {
        "stereo_imbalance_qc_flag": flagged, "FAIL_clipping": F.col("clipped") > 0, "near_clipped_samples": F.col("near_clipped") > 0, "severe_channel_energy_difference": F.col("channel_gap_db") > 6,
        "mono_duplicate_channels": F.col("mono_duplicate"), "phase_correlation_review": F.abs("phase") < 0.05, "loudness_normalisation_review": ~normalised,
    }
    text = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()))), ";")
    return out.withColumn("reasons", text).withColumn("status", F.when(F.col("reasons").contains("FAIL"), "FAIL").when(F.col("reasons") == "", "PASS").otherwise("REVIEW")).drop("clipped_frames")


def probe(a: Column) -> Column:
    """What a decoded signal is: readable, finite, peak, rms, near_silent (below 1e-5), clipping (from .999)."""
    finite = F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    readable = a.isNotNull() & (F.size(a) > 0)
    peak = F.array_max(F.transform(a, F.abs))
    return F.struct(readable.alias("readable"), F.coalesce(readable & finite, F.lit(False)).alias("finite"), peak.alias("peak"), signals.rms(a).alias("rms"), F.coalesce(peak < 1e-5, F.lit(False)).alias("near_silent"), F.coalesce(peak >= 0.999, F.lit(False)).alias("clipping"))


def strongest_peaks(df: DataFrame, group: str, at: str, level: str, k: int) -> DataFrame:
    """(group, at, level, position): local maxima of a curve, the `k` highest of each group (ties to the earlier), in time order."""
    w = W.partitionBy(group).orderBy(at)
    peaks = df.withColumn("_p", F.lag(level).over(w)).withColumn("_n", F.lead(level).over(w)).where((F.col(level) > F.col("_p")) & (F.col(level) >= F.col("_n")))
    top = peaks.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(level), at))).where(F.col("_r") <= k)
    return top.select(group, at, level, F.row_number().over(w).alias("position"))


def refined_lag(a: DataFrame, b: DataFrame, at: str, value: str, coarse: int, within: int) -> DataFrame:
    """(lag, n, r): the best lag within `within` steps of a coarse one; ties to the lower."""
    near = signals.lag_correlations(a, b.withColumn(at, F.col(at) - F.lit(coarse)), at, value, within)
    return near.select((F.col("lag") + coarse).alias("lag"), "n", "r").orderBy(F.desc("r"), "lag").limit(1)


def alignment_rollup(pairs: DataFrame, by: list[str], offset_ms: str, r: str, confidence: str, status: str) -> DataFrame:
    """Per set: the largest offset, least correlation and confidence, and the worst status of its pairs."""
    return pairs.groupBy(*by).agg(F.max(F.abs(F.col(offset_ms))).alias("largest_offset_ms"), F.min(r).alias("least_r"), F.min(confidence).alias("confidence"), signals.worst_status(F.col(status)).alias("status"))
