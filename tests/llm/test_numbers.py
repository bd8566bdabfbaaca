"""Percentiles, consensus and subsets against brute force and on awkward input."""

import bisect
import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import consensus, quantiles, queries, subset


def test_order_preserving_integers(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, 0.3, 1 - 2.0**-53, 2.0**52 + 0.5]
    values += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(3000)] + [rng.random() for _ in range(1000)] + [2.0**k for k in range(-1074, 1024, 7)]
    values = [v for v in values if math.isfinite(v)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.to_ordered(F.col("v")).alias("k"))
    rows = df.select("v", "k", quantiles.from_ordered(F.col("k")).alias("back")).collect()
    assert all(r.v == r.back for r in rows)
    for r in rows:
        bits = struct.unpack("q", struct.pack("d", abs(r.v)))[0]
        assert r.k == (bits if r.v >= 0 else -bits - 1)


def test_percentiles_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(g, f"d{rng.randrange(3)}", rng.choice([rng.random(), 0.5, 0.5, None, float("nan"), float("inf"), -0.0, 7.0])) for g in ("a", None, "big") for _ in range(30 if g != "big" else 2000)] + [("void", "d0", None)]
    df = spark.createDataFrame(rows, "g string, day string, x double").selectExpr("*", "x AS y", "1 AS measure_", "2 AS key", "3 AS n", "4 AS prefix")
    got = {(r.g, r.measure, r.p): (r.n, r.value) for r in quantiles.percentiles(df, ["g"], ["x", "y"], [0.0, 0.05, 0.5, 0.95, 1.0], 0.0, 1.0).collect()}
    for g in ("a", None, "big"):
        x = sorted(v for h, _, v in rows if h == g and v is not None and 0 <= v <= 1)
        for p in (0.0, 0.05, 0.5, 0.95, 1.0):
            want = (len(x), x[max(1, math.ceil(round(p * len(x), 6))) - 1])
            assert got[g, "x", p] == want and got[g, "y", p] == want
    assert not [k for k in got if k[0] == "void"]
    assert quantiles.percentiles(df.limit(0), ["g"], ["x"], [0.5]).count() == 0


def test_summaries_of_days_are_merged(spark):
    """Percentiles read off the days' summaries alone stay within one percent of rank, crowded values included."""
    rng = random.Random(11)
    rows = [(f"d{k % 7}", "g", rng.choice([0.75 + rng.random() * 1e-6, 0.5, rng.random()])) for k in range(6000)] + [("d9", "g", 0.25), ("d0", None, 0.1)]
    df = spark.createDataFrame(rows, "day string, g string, x double")
    parts = [quantiles.radix_summary(df.where(c), ["g"], ["x"], "day") for c in ("day < 'd3'", "day >= 'd3'")]
    assert parts[0].count() < 2600
    x = sorted(v for _, g, v in rows if g)
    for r in quantiles.summary_percentiles(parts[0].unionByName(parts[1]), ["g"], [0.05, 0.25, 0.5, 0.75, 0.95]).where("g is not null").collect():
        below, upto = bisect.bisect_left(x, r.value), bisect.bisect_right(x, r.value)
        assert r.n == len(x) and below - 0.01 * len(x) <= r.p * len(x) <= upto + 0.01 * len(x)


def _study(seed):
    rng = np.random.default_rng(seed)
    quality = rng.random(40)
    rows, bad = [], {"r0", "r1", "r2", "flat"}
    for p in [*(f"p{i}" for i in range(25)), *bad]:
        for k, q in enumerate(quality):
            s = rng.random() if p in bad else 0.2 + 0.5 * q + 0.05 * rng.normal()  # cautious, but following
            s = 0.4 if p == "flat" else min(1.0, max(0.0, s))
            rows.append((f"{p}-{k}", p, f"m{k:02}", float(s), dt.datetime(2024, 1, 1)))
    return rows, quality, bad


def test_consensus_and_reliability(spark):
    rows, quality, bad = _study(4)
    extra = [(rows[0][0], *rows[0][1:3], rows[0][3], dt.datetime(2024, 2, 1)), ("n1", "p0", "m00", None, None), ("n2", "p0", "m00", 1.5, None), ("n3", None, "m00", 0.5, None), ("n4", "p0", None, 0.5, None), ("n5", "lone", "m99", 0.5, None)]
    df = spark.createDataFrame(rows + extra, "id string, who string, what string, s double, got timestamp_ntz").selectExpr("*", "1 AS label", "2 AS annotator", "3 AS item", "4 AS score")
    labels = consensus.distinct_labels(df, "id", "who", "what", "s", "got")
    assert labels.count() == len(rows) + 3
    edges = consensus.label_edges(labels)
    items, annotators = consensus.pass_messages(edges)
    r = {a.annotator: a.reliability for a in annotators.collect()}
    assert min(r[f"p{i}"] for i in range(25)) > 0.6 > 0.4 > max(r[b] for b in bad), r
    c = {a.annotator: a.correlation for a in consensus.others_correlation(edges).collect()}
    assert c["flat"] == 0 and "lone" not in c
    y = {k: np.mean([s for _, p, m, s, _ in rows if m == k and p != "p3"]) for k in {m for _, _, m, _, _ in rows}}
    own = [(s, y[m]) for _, p, m, s, _ in rows if p == "p3"]
    assert abs(c["p3"] - np.corrcoef(*zip(*own))[0, 1]) < 1e-9
    got = {i.item: i.label for i in consensus.consensus(items).collect()}
    order = np.argsort(quality)
    assert all(got[f"m{k:02}"] == "low" for k in order[:8]) and all(got[f"m{k:02}"] == "high" for k in order[-8:])


def _hot_mix(participants=30, mixes=45, once=4000):
    """A study in which one mix holds most labels; "two_faced" scores it like everybody, and all other mixes at random."""
    rng = np.random.default_rng(6)
    quality, rows = rng.random(mixes), []
    for p in [*(f"p{i}" for i in range(participants)), "two_faced"]:
        scores = rng.random(mixes) if p == "two_faced" else np.clip(0.2 + 0.6 * quality + 0.05 * rng.normal(size=mixes), 0, 1)
        rows += [(f"{p}-{k}", p, f"m{k:02}", float(s)) for k, s in enumerate(scores)] + [(f"{p}-hot", p, "hot", 1.0)]
    for i in range(once):
        rows += [(f"o{i}-hot", f"o{i}", "hot", 0.9), (f"o{i}-x", f"o{i}", f"x{i % 9}", 0.1)]
    return [(*r, dt.datetime(2024, 1, 1)) for r in rows]


def test_hot_mix_hides_nobody(spark, tmp_path):
    df = spark.createDataFrame(_hot_mix(), "evaluation_id string, participant_id string, mix_id string, preference_score_0_1 double, received_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "evaluations.parquet"))
    assert [r.participant_id for r in queries.p2_found(spark, str(tmp_path)).collect()] == ["two_faced"]


def test_messages_converge_or_say_so(spark):
    df = spark.createDataFrame(_hot_mix(), "id string, who string, what string, s double, got timestamp_ntz")
    edges = consensus.cut(consensus.label_edges(consensus.distinct_labels(df, "id", "who", "what", "s", "got")))
    r = {a.annotator: a.reliability for a in consensus.pass_messages(edges)[1].collect()}
    assert r["two_faced"] < 0.4 < 0.6 < min(r[f"p{i}"] for i in range(30)), r  # the hot mix weighs like any other
    assert all(a.converged for a in consensus.pass_messages(edges)[1].collect())
    assert not all(a.converged for a in consensus.pass_messages(edges, most_iterations=1)[1].collect())


def _messages_by_brute_force(edges, iterations):
    """The same messages, edge by edge: {annotator: reliability} and {item: weights of the classes}."""
    n = {e: sum(c) for e, c in edges.items()}
    total = sum(n.values())
    p = [sum(c[k] for c in edges.values()) / total for k in range(3)]
    a = {e: [c[k] - n[e] * p[k] for k in range(3)] for e, c in edges.items()}
    aa = {e: [c[k] * (1 - p[k]) ** 2 + (n[e] - c[k]) * p[k] ** 2 for k in range(3)] for e, c in edges.items()}
    y = {e: [1.0] * 3 for e in edges}

    def corr(rows, k):
        m = sum(n[e] for e, _ in rows)
        sa, saa, sb, sbb, sab = sum(a[e][k] for e, _ in rows), sum(aa[e][k] for e, _ in rows), sum(n[e] * h for e, h in rows), sum(n[e] * h * h for e, h in rows), sum(a[e][k] * h for e, h in rows)
        va, vb = m * saa - sa * sa, m * sbb - sb * sb
        return ((m * sab - sa * sb) / math.sqrt(va * vb), saa / m - (sa / m) ** 2) if va > 1e-9 * m * m and vb > 1e-9 * m * m else (0.0, max(0.0, saa / m - (sa / m) ** 2) if m else 0.0)

    for step in range(iterations + 1):
        x, weights = {}, {}
        for who, what in edges:
            near = [e for e in edges if e[1] == what]
            weights[what] = [sum(a[e][k] * y[e][k] for e in near) for k in range(3)]
            others = [e for e in near if e[0] != who]
            x[who, what] = [sum(a[e][k] * y[e][k] for e in others) / v if (v := sum(n[e] * abs(y[e][k]) for e in others)) > 1e-9 else 0.0 for k in range(3)]
        shared = {e for e in edges if any(f[1] == e[1] and f[0] != e[0] for f in edges)}
        own = {who: [e for e in edges if e[0] == who and e in shared] for who, _ in edges}
        whole = {who: [corr([(e, x[e][k]) for e in es], k) for k in range(3)] for who, es in own.items()}
        if step == iterations:
            return {who: sum(c * v for c, v in whole[who]) / max(sum(v for _, v in whole[who]), 1e-12) for who in own if own[who]}, weights
        y = {e: [corr([(f, x[f][k]) for f in own[e[0]] if f != e], k)[0] for k in range(3)] for e in edges}


def test_messages_by_brute_force(spark):
    rng = np.random.default_rng(12)
    quality = rng.random(9)
    edges = {(f"p{i}", f"m{k}"): [int(v) for v in np.bincount(np.digitize(np.clip(quality[k] + (0.1 if i < 9 else 0.8) * rng.normal(size=1 + (k == 0)), 0, 1), [0.33, 0.67]), minlength=3)] for i in range(12) for k in range(9) if rng.random() < 0.9}
    df = spark.createDataFrame([(w, m, sum(c), 0.0, 0.0, *c) for (w, m), c in edges.items()], "annotator string, item string, n bigint, s double, ss double, c0 int, c1 int, c2 int")
    items, annotators = consensus.pass_messages(df, most_iterations=1)
    reliability, weights = _messages_by_brute_force(edges, 1)
    assert {a.annotator: round(a.reliability, 4) for a in annotators.collect()} == {k: round(v, 4) for k, v in reliability.items()}
    assert all(abs(i[f"x{k}"] - weights[i["item"]][k]) < 1e-4 for i in items.collect() for k in range(3))


def test_consensus_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, who string, what string, s double, got timestamp_ntz")
    edges = consensus.label_edges(consensus.distinct_labels(empty, "id", "who", "what", "s", "got"))
    items, annotators = consensus.pass_messages(edges)
    assert items.count() == 0 and annotators.count() == 0


def test_kinds_and_subsets(spark):
    rng = np.random.default_rng(8)
    rows, true = [], {}
    for g in range(3):
        for k in range(5):
            for j in range(1 + 30 * (k == 0)):
                v = np.array([10.0 * k, 10.0 * g]) + rng.uniform(-0.3, 0.3, 2)
                true[f"g{g}", f"m{k}-{j}"] = k
                rows.append((len(rows), f"g{g}", f"m{k}-{j}", float(v[0]), float(v[1]), f"i{k}"))
    rows += [(900, "g0", "bad", None, 1.0, "x"), (901, "g0", "worse", float("nan"), 1.0, "x"), (902, *rows[0][1:]), (903, None, "z", 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "id int, g string, m string, a double, b double, inst string").selectExpr("*", "1 AS grp", "2 AS member", "3 AS vec")
    pool = subset.pools(df, "g", "m", "id", ["a", "b"], ["inst"])
    for block in (5_000, 7):  # one block, and several that are pooled
        rows = subset.kinds(pool, 1.0, block).collect()
        found = {(r.grp, r.member): r.kind for r in rows}
        assert set(found) == set(true) and {r.pool_kinds for r in rows} == {5}
        assert all((found[a] == found[b]) == (true[a] == true[b]) for a in found for b in found if a[0] == b[0])
        assert subset.representatives(pool, 4, block).count() == 12
    sel = spark.createDataFrame([(1, "g0", "m0-0| m0-1 |m1-0"), (2, "g0", "m0-0|m1-0|m2-0|m3-0|m4-0|m0-2"), (3, "g0", "m0-0|m0-0|m1-0"), (4, "g1", "nope|m0-0"), (5, None, None), (6, "g9", "m0-0|m0-1")], "id bigint, g string, mixes string")
    chosen = subset.selected_members(sel, "id", "g", "mixes")
    assert [r.selection for r in subset.crowded_selections(pool, chosen, 1.0).collect()] == [1]
    report = subset.subset_report(pool, 5, "inst").collect()
    assert len(report) == 3 and all(r.subset_size == 5 and r.unique_institution_count == 5 and r.minimum_pairwise_distance > 9 for r in report)
    assert subset.subset_report(pool.limit(0), 5, "inst").count() == 0
    assert subset.farthest_first(np.zeros((3, 2)), 2, None) == [0, 1] and subset.farthest_first(np.zeros((3, 2)), None, 1.0) == [0]
