"""Time lines and signals: interval coverage, overlap, separated top windows, lag search, level features, frames, fades.

Band joins carry the group and a coarse time bucket as equi keys, so a window meets only the samples of its buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions.numeric import bound


def window_join(windows: DataFrame, samples: DataFrame, group: str, start: str, end: str, at: str, bucket: float) -> DataFrame:
    """Each window with the samples of its group at start <= t < end (windows without samples stay, with nulls)."""
    w = windows.withColumn("_w", F.monotonically_increasing_id()) if "_w" not in windows.columns else windows
    pieces = w.select("*", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("_b"))
    s = samples.withColumn("_b", F.floor(F.col(at) / bucket)).withColumnRenamed(group, "_g")
    hit = pieces.join(s, (F.col(group) == F.col("_g")) & (pieces["_b"] == s["_b"]) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    return hit.drop("_b", "_g")


def coverage(windows: DataFrame, samples: DataFrame, group: str, start: str, end: str, at: str, value: str, bucket: float) -> DataFrame:
    """(group, start, end, samples, coverage): mean of the samples within each window, 0 where there are none."""
    hit = window_join(windows.select(group, start, end).distinct(), samples.select(group, at, value), group, start, end, at, bucket)
    got = hit.groupBy(group, start, end).agg(F.count(F.lit(1)).alias("samples"), F.avg(value).alias("coverage"))
    return windows.select(group, start, end).distinct().join(got, [group, start, end], "left").withColumn("samples", F.coalesce("samples", F.lit(0).cast("bigint"))).withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def common_overlap(df: DataFrame, group: str, start: Column, end: Column) -> DataFrame:
    """Per group the interval all members share: latest start to earliest end, and its length (0 if none)."""
    got = df.groupBy(group).agg(F.max(start).alias("start"), F.min(end).alias("end"))
    return got.withColumn("length", F.greatest(F.lit(0.0), F.col("end") - F.col("start")))


def separated_top(df: DataFrame, group: str, at: str, score: str, k: int, gap: float) -> DataFrame:
    """(grp, at, score, position): the best `k` of each group, greedily, none nearer than `gap` to one chosen before; ties to the earlier."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: list[tuple[float, float]] = []
        for t, s in pdf.sort_values(["score", "at"], ascending=[False, True])[["at", "score"]].itertuples(index=False):
            if all(abs(t - c) >= gap for c, _ in chosen):
                chosen.append((t, s))
                if len(chosen) == k:
                    break
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "at": [c[0] for c in chosen], "score": [c[1] for c in chosen], "position": range(1, len(chosen) + 1)})

    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(at).cast("double").alias("at"), F.col(score).cast("double").alias("score")).where("grp is not null and at is not null and score is not null")
    return rows.groupBy("grp").applyInPandas(choose, "grp string, at double, score double, position int")


def lag_correlations(a: DataFrame, b: DataFrame, at: str, value: str, most: int) -> DataFrame:
    """(lag, n, r): correlation of a(t) with b(t + lag) over common t, for lags -most..most; -1 where n <= 4 or a side is flat."""
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")
    left = a.select(F.col(at).alias("t"), F.col(value).alias("u"), lags).withColumn("_t", F.col("t") + F.col("lag"))
    both = left.join(b.select(F.col(at).alias("_t"), F.col(value).alias("v")), "_t")
    flat = (F.count(F.lit(1)) <= 4) | (F.stddev_pop("u") < 1e-12) | (F.stddev_pop("v") < 1e-12)
    return both.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.when(flat, F.lit(-1.0)).otherwise(F.corr("u", "v")).alias("r"))


def best_lag(r: DataFrame, apart: int = 1) -> DataFrame:
    """One row: best lag (ties to the lower), its correlation, the best one more than `apart` away, margin, multimodal, confidence."""
    best = r.agg(F.max(F.struct("r", (-F.col("lag")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("best_lag"), F.col("b.r").alias("best_r"))
    second = r.join(F.broadcast(best)).where(F.abs(F.col("lag") - F.col("best_lag")) > apart).agg(F.max("r").alias("second_r"))
    out = best.join(F.broadcast(second)).withColumn("margin", F.col("best_r") - F.col("second_r"))
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return out.withColumn("multimodal", F.col("second_r") > 0.92 * F.col("best_r")).withColumn("confidence", clamp(0.75 * F.col("best_r") + 0.25 * clamp(F.col("margin") / 0.15)))


def grade(offset: Column, r: Column) -> Column:
    """PASS within 10 ms and from .60, REVIEW within 30 ms and from .35, else FAIL."""
    return F.when((F.abs(offset) <= 0.010) & (r >= 0.60), "PASS").when((F.abs(offset) <= 0.030) & (r >= 0.35), "REVIEW").otherwise("FAIL")


def worst_status(status: Column) -> Column:
    """Aggregate: the worst of FAIL, REVIEW, PASS."""
    rank = F.max(F.when(status == "FAIL", 2).when(status == "REVIEW", 1).otherwise(0))
    return F.when(rank == 2, "FAIL").when(rank == 1, "REVIEW").otherwise("PASS")


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))


def rms(a: Column) -> Column:
    return F.sqrt(_sum(a, lambda v: v * v) / F.size(a))


def crest_db(a: Column) -> Column:
    """Peak over RMS in dB."""
    peak = F.aggregate(a, F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v)))
    return 20 * F.log10(F.greatest(peak, F.lit(1e-12)) / F.greatest(rms(a), F.lit(1e-12)))


def stereo_width(left: Column, right: Column) -> Column:
    """Energy of the difference over energy of the sum."""
    side = _sum(F.zip_with(left, right, lambda x, y: (x - y) * (x - y)), lambda v: v)
    mid = _sum(F.zip_with(left, right, lambda x, y: (x + y) * (x + y)), lambda v: v)
    return F.when(mid > 1e-12, side / mid).otherwise(0.0)


def stereo_imbalance(left: Column, right: Column) -> Column:
    """(right - left) / (right + left) energy, within -1..1."""
    el, er = _sum(left, lambda v: v * v), _sum(right, lambda v: v * v)
    return F.when(el + er > 1e-12, (er - el) / (er + el)).otherwise(0.0)


def standardised(a: Column) -> Column:
    """z-normalised array; a flat one becomes zeros."""
    n = F.size(a)

    def scaled(mean: Column) -> Column:
        sd = F.sqrt(_sum(a, lambda v: (v - mean) * (v - mean)) / n)
        return bound(sd, lambda s: F.transform(a, lambda v: F.when(s > 1e-12, (v - mean) / s).otherwise(0.0)))

    return bound(_sum(a, lambda v: v) / n, scaled)


def onset(a: Column) -> Column:
    """Rises only: max(0, first difference), the first being 0."""
    return F.transform(a, lambda v, i: F.when(i == 0, 0.0).otherwise(F.greatest(F.lit(0.0), v - F.try_element_at(a, i.cast("int")))))


def faded(a: Column, samples: int) -> Column:
    """Half-cosine fade-in and fade-out over `samples` at each end."""
    n = F.size(a)
    ramp = lambda k: 0.5 - 0.5 * F.cos(F.lit(np.pi) * (k + 0.5) / samples)
    return F.transform(a, lambda v, i: v * F.when(i < samples, ramp(i)).otherwise(1.0) * F.when(i >= n - samples, ramp(n - 1 - i)).otherwise(1.0))


def fingerprint(a: Column, segments: int = 32) -> Column:
    """SHA-1 over the RMS of equal segments, rounded to 5 digits (shorter arrays have shorter fingerprints)."""
    n = F.size(a)
    part = lambda k: F.slice(a, (F.floor(k * n / segments) + 1).cast("int"), F.greatest(F.lit(1), (F.floor((k + 1) * n / segments) - F.floor(k * n / segments)).cast("int")))
    marks = F.transform(F.sequence(F.lit(0), F.least(F.lit(segments), n) - 1), lambda k: F.format_string("%.5f", rms(part(k))))
    return F.when(n > 0, F.sha1(F.array_join(marks, ",")))


def frame_rms(a: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """RMS of overlapping frames."""
    if len(a) < frame:
        return np.zeros(0)
    v = np.lib.stride_tricks.sliding_window_view(np.asarray(a, dtype=float), frame)[::hop]
    return np.sqrt((v * v).mean(axis=1))


def envelopes(df: DataFrame, key: str, samples: str, frame: int, hop: int, flux_share: float = 0.45) -> DataFrame:
    """(key, envelope): standardised frame RMS mixed with standardised spectral flux, for alignment."""

    def z(x: np.ndarray) -> np.ndarray:
        return (x - x.mean()) / x.std() if len(x) and x.std() > 1e-12 else np.zeros(len(x))

    def run(batches):
        for pdf in batches:
            out = []
            for a in pdf["samples"]:
                a = np.asarray(a, dtype=float)
                level = frame_rms(a, frame, hop)
                if len(level):
                    spectra = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(a, frame)[::hop] * np.hanning(frame), axis=1))
                    flux = np.maximum(0, np.diff(spectra, axis=0, prepend=spectra[:1])).sum(axis=1)
                    level = (1 - flux_share) * z(level) + flux_share * z(flux)
                out.append(level.tolist())
            yield pd.DataFrame({"key": pdf["key"], "envelope": out})

    return df.select(F.col(key).cast("string").alias("key"), F.col(samples).cast("array<double>").alias("samples")).where("samples is not null").mapInPandas(run, "key string, envelope array<double>")


def rolling_rise(df: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """Adds `rise`, max(0, x - previous x) along time within the group; 0 for the first."""
    return df.withColumn("rise", F.coalesce(F.greatest(F.lit(0.0), F.col(value) - F.lag(value).over(W.partitionBy(group).orderBy(at))), F.lit(0.0)))


def mono(left: Column, right: Column) -> Column:
    """Mean of two channels; the shorter one counts as silence beyond its end."""
    return F.zip_with(left, right, lambda x, y: (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))) / 2)


def spliced(a: Column, b: Column, at: Column, cross: int) -> Column:
    """`a` up to `at`, then `b` from there on, with a linear cross-fade of `cross` samples that begins at `at`."""
    mix = F.zip_with(F.slice(a, at + 1, F.lit(cross)), F.slice(b, at + 1, F.lit(cross)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    faded = F.transform(mix, lambda s, i: s["x"] * (1 - (i + 1) / (cross + 1)) + s["y"] * ((i + 1) / (cross + 1)))
    return F.concat(F.slice(a, F.lit(1), at), faded, F.slice(b, at + cross + 1, F.greatest(F.lit(0), F.size(b) - at - cross)))


def levelled(a: Column, target_db: float, peak: float = 0.999) -> Column:
    """A signal at the target RMS level in dB, but with no sample beyond `peak`; silence stays."""
    want = F.lit(10 ** (target_db / 20))
    top = F.array_max(F.transform(a, F.abs))
    gain = F.least(want / F.greatest(rms(a), F.lit(1e-12)), F.lit(peak) / F.greatest(top, F.lit(1e-12)))
    return F.when(top > 1e-12, bound(gain, lambda g: F.transform(a, lambda v: v * g))).otherwise(a)


def bark_filters(rate: int, size: int, bands: int = 24, low: float = 20.0, high: float = 20_000.0) -> np.ndarray:
    """Triangular filters (bands x bins) equally spaced on the Bark scale, 26.81 f / (1960 + f) - 0.53."""
    z = lambda f: 26.81 * f / (1960.0 + f) - 0.53
    at = z(np.fft.rfftfreq(size, 1 / rate))
    edges = np.linspace(z(low), z(min(high, rate / 2)), bands + 2)
    rise = (at[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - at[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(rise, fall), 0.0, None)


def bark_spectrum(left: np.ndarray, right: np.ndarray, rate: int, size: int = 32_768, hop: int = 8_192, bands: int = 24, eps: float = 1e-8) -> np.ndarray:
    """Mean log magnitudes of the mid and the side signal in Bark bands (2 x bands values, mid first); short signals are padded."""
    out = []
    filters, window = bark_filters(rate, size, bands), np.hanning(size)
    for x in ((left + right) / 2, (left - right) / 2):
        x = np.pad(x, (0, max(0, size - len(x))))
        frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
        total = np.zeros(bands)
        for f in frames:  # one frame at a time, so that long signals stay small
            total += np.log(filters @ np.abs(np.fft.rfft(f * window)) + eps)
        out.append(total / len(frames))
    return np.concatenate(out)


def bark_spectra(df: DataFrame, key: str, left: str, right: str, rate: int, size: int = 32_768, hop: int = 8_192) -> DataFrame:
    """(key, bark): 48 values of each signal, in Arrow batches; null where a channel is missing or empty."""
    import pyarrow as pa

    schema = pa.schema([("key", pa.string()), ("bark", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            got = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                got.append(bark_spectrum(np.array(a, dtype=float), np.array(b, dtype=float), rate, size, hop).tolist() if a and b and len(a) == len(b) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, schema.field(1).type)], schema=schema)

    return df.select(F.col(key).cast("string").alias("key"), F.col(left).cast("array<double>"), F.col(right).cast("array<double>")).mapInArrow(run, "key string, bark array<double>")


def array_alignment(a: Column, b: Column, most: int) -> Column:
    """struct(lag, r, second_r, confidence) of two envelopes in a row: the best correlation over lags -most..most of b against a, ties to the lower lag.

    The correlation of fewer than five common samples, or of a flat side, is -1. `second_r` is the best more than one step away from the best lag.
    """
    n = F.size(a)

    def parts(lag: Column) -> Column:
        size = F.greatest(F.lit(0), F.least(n, F.size(b) - lag) - F.greatest(F.lit(0), -lag))
        return F.struct(F.slice(a, F.greatest(F.lit(0), -lag) + 1, size).alias("x"), F.slice(b, F.greatest(F.lit(0), lag) + 1, size).alias("y"), size.alias("n"))

    def correlation(p: Column) -> Column:
        def of(m: Column) -> Column:
            dx, dy = F.transform(p["x"], lambda v: v - m["x"]), F.transform(p["y"], lambda v: v - m["y"])
            dot = lambda u, v: _sum(F.zip_with(u, v, lambda s, t: s * t), lambda v: v)
            xx, yy = dot(dx, dx), dot(dy, dy)
            return F.when((p["n"] <= 4) | (xx <= 1e-12) | (yy <= 1e-12), F.lit(-1.0)).otherwise(dot(dx, dy) / F.sqrt(xx * yy))

        mean = lambda c: _sum(c, lambda v: v) / F.greatest(p["n"], F.lit(1))
        return bound(F.struct(mean(p["x"]).alias("x"), mean(p["y"]).alias("y")), of)

    found = F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda lag: F.struct(F.round(bound(parts(lag), correlation), 9).alias("r"), (-lag).alias("m")))

    def best(s: Column) -> Column:
        top = F.array_max(s)
        second = F.array_max(F.transform(F.filter(s, lambda x: F.abs(x["m"] - top["m"]) > 1), lambda x: x["r"]))
        clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
        return F.struct((-top["m"]).alias("lag"), top["r"].alias("r"), second.alias("second_r"), clamp(0.75 * top["r"] + 0.25 * clamp((top["r"] - second) / 0.15)).alias("confidence"))

    return bound(found, best)
