"""Hand-checked cases of the operators."""

import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.functions import numeric, stats, text
from tonelake.operators import combos, design, inventory, preferences, quality, ratings, signals, vectors
from tonelake.sources import files, tables
from tonelake.streaming import ingest


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_t_quantiles():
    t = stats.t_table()
    assert abs(t[1] - 4.302653) < 1e-6 and abs(t[8] - 2.262157) < 1e-6 and abs(t[28] - 2.045230) < 1e-6


def test_t_series_meets_table(spark):
    assert abs(one(spark, stats.t975(F.lit(201.0))) - stats.t_table(df=201)[-1]) < 1e-6
    assert one(spark, stats.t975(F.lit(0.0))) is None


def test_text_functions(spark):
    cases = [(text.safe_name(F.lit("--a b/ü!")), "a_b"), (text.safe_name(F.lit("///")), "unnamed_mix"), (text.file_stem(F.lit("x\\y/Bass DI.wav")), "Bass DI"), (text.header_name(F.lit("Group ID (new)")), "group_id_new"), (text.version_label(F.lit(" VERSION  b\t")), "b"), (text.id_key(F.lit(" \t")), None), (text.slug(F.lit("Ab-1 é")), "Ab1é")]
    for expr, want in cases:
        assert one(spark, expr) == want
    assert one(spark, numeric.clamp(F.lit(None).cast("double"), 0, 1)) is None
    assert one(spark, numeric.parse_double(F.lit("abc"))) is None and one(spark, numeric.parse_double(F.lit("inf"))) is None


def test_join_status(spark):
    facts = spark.createDataFrame([(1, "a", "m"), (2, "z", "m"), (3, "a", None), (4, "z", "y")], "k int, s string, m string")
    got = inventory.join_status(facts, {"song": (spark.createDataFrame([("a",)], "id string"), "s", "id"), "mix": (spark.createDataFrame([("m",)], "id string"), "m", "id")})
    assert {r.k: r.join_status for r in got.collect()} == {1: "matched", 2: "missing_song", 3: "missing_mix", 4: "missing_song_and_mix"}


def test_rating_summary(spark):
    rows = [("m", x, "p", "i") for x in (0.2, 0.4, 0.6)] + [("one", 0.5, "p", ""), ("none", None, "p", "i"), ("none", float("nan"), "q", "i")]
    got = {r.item: r for r in ratings.rating_summary(spark.createDataFrame(rows, "item string, s double, p string, i string"), "item", "s", "p", "i").collect()}
    assert got["m"].n == 3 and abs(got["m"].ci_low + 0.09683) < 1e-5 and abs(got["m"].ci_high - 0.89683) < 1e-5 and got["m"].low_count
    assert got["one"].ci_method == "unavailable" and got["one"].sd is None and got["one"].institution_count == 0
    assert got["none"].status == "unrated" and got["none"].missing == 2 and got["none"].raters == 2


def test_within_group(spark):
    df = spark.createDataFrame([("A", 0.1, 1.0, 1), ("A", 0.9, 1.0, 1), ("B", 0.1, None, 2), ("B", 0.1, None, 4)], "g string, x double, se double, n int")
    got = sorted((r.g, r.x, r.rank, round(r.centred, 9), r.z, r.weight) for r in ratings.within_group(df, "g", "x", "se", "n").collect())
    assert [g[2] for g in got] == [1.0, 2.0, 1.5, 1.5] and got[0][3] == -0.4 and got[2][4] is None and [g[5] for g in got[2:]] == [0.5, 1.0]


def _pool(spark, xs, grp="g"):
    return spark.createDataFrame([(grp, f"m{i:02}", i + 1, [float(v) for v in (x if isinstance(x, tuple) else (x,))]) for i, x in enumerate(xs)], "grp string, member string, idx int, x array<double>")


def test_vectors_by_hand(spark):
    scaled = vectors.robust_scale(_pool(spark, [(1, 5), (2, 5), (3, 5)])).orderBy("idx").collect()
    assert [r.x for r in scaled] == [[-1, 0], [0, 0], [1, 0]]
    weighted = vectors.block_weight(_pool(spark, [(1, 0), (0, 2), (2, 2)])).collect()
    assert abs(np.mean([sum(v * v for v in r.x) for r in weighted]) - 1) < 1e-12
    e = vectors.edges(_pool(spark, [0, 1, 2, 10]))
    assert vectors.medoids(e).first().medoid == 2
    t = combos.triples(e)
    assert tuple(combos.best_triples(t).select("a", "b", "c").first()) == (1, 3, 4)
    assert tuple(combos.best_triples(t, vectors.medoids(e)).select("a", "b", "c").first()) == (1, 2, 4)
    assert sorted(r.d for r in vectors.edges(_pool(spark, [(0, 0), (3, 4), (6, 8)])).collect()) == [5, 5, 10]


def test_medoid_triples_and_pools(spark):
    pool = _pool(spark, [0, 0.1, 5, 5.1, 10, 10.1])
    e = vectors.edges(pool)
    whole = vectors.both_ways(e).unionByName(pool.select("grp", F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(0.0).alias("d")))
    assert tuple(combos.medoid_triples(combos.triples(e), whole).select("a", "b", "c").first()) in {(1, 3, 5), (1, 3, 6)}
    near = spark.createDataFrame([("g", 1, 2, 0.01)], "grp string, i int, j int, d double")
    chosen = [r.member for r in vectors.farthest_pool(_pool(spark, [0, 0.01, 5, 10]), 3, near).orderBy("position").collect()]
    assert "m00" not in chosen or "m01" not in chosen
    assert vectors.greedy_medoids(_pool(spark, [0, 1]), 5).count() == 2
    assert vectors.explained_variance(spark.createDataFrame([("g", [1.0, 2.0])], "g string, x array<double>"), "g", "x").count() == 0


def test_degenerate_triples(spark):
    e = spark.createDataFrame([("s", 1, 2, 1.0), ("s", 1, 3, 3.0), ("s", 1, 4, 4.0), ("s", 2, 3, 2.5), ("s", 2, 4, 3.5), ("s", 3, 4, 1.0)], "grp string, i int, j int, d double")
    scores = spark.createDataFrame([("s", i + 1, f"m{i}", v, t, "clear") for i, (v, t) in enumerate([(0.1, 0), (0.2, 0), (0.8, 2), (0.9, 2)])], "grp string, idx int, name string, score double, third int, status string")
    t = combos.triple_objective(combos.triples(e), scores)
    assert t.count() == 8 and all(r.min_d == 1 for r in t.collect())
    r = combos.ranked(t)
    assert r.where("rank = 1").count() == 2 and combos.least_overlap(r).count() == 1


def test_winners(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (1, "c", 7), (1, "c", 7), (2, "a", 1), (3, "x", None)], "t int, i string, s int")
    w = preferences.winners(df, ["t"], "i", "s")
    assert {r.t: (r.winners, r.tie, r.scored) for r in w.collect()} == {1: ("b|c", True, 4), 2: ("a", False, 1)}
    assert preferences.joint_winners(w, ["t"]).count() == 2
    assert {r.t: r.preferred for r in preferences.derived_preference(w, ["t"]).collect()} == {1: None, 2: "a"}


def test_intervals(spark):
    curve = spark.createDataFrame([("v", k * 0.25, float(4 <= k * 0.25 < 34)) for k in range(161)], "g string, t double, a double")
    w = spark.createDataFrame([("v", 4.0, 8.0), ("v", 0.0, 4.0), ("v", 100.0, 104.0)], "g string, s double, e double")
    got = {r.s: r.coverage for r in signals.coverage(w, curve, "g", "s", "e", "t", "a", 3.0).collect()}
    assert got == {4.0: 1.0, 0.0: 0.0, 100.0: 0.0}
    lags = spark.createDataFrame([("x", 0.0, 10.0), ("x", 0.75, 9.0)], "g string, lag double, dur double")
    assert signals.common_overlap(lags, "g", -F.col("lag"), F.col("dur") - F.col("lag")).select("start", "end").first() == (0.0, 8.25)
    top = signals.separated_top(spark.createDataFrame([("g", float(t), float(s)) for t, s in [(0, 5), (1, 9), (2, 8), (9, 1)]], "g string, t double, s double"), "g", "t", "s", 3, 1.5)
    assert [r["at"] for r in top.orderBy("position").collect()] == [1.0, 9.0]


def test_known_lag(spark):
    x = np.random.default_rng(3).normal(size=200)
    a = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, v double")
    b = spark.createDataFrame([(i + 3, float(v)) for i, v in enumerate(x)], "t int, v double")
    best = signals.best_lag(signals.lag_correlations(a, b, "t", "v", 5)).first()
    assert best.best_lag == 3 and best.best_r > 0.99 and not best.multimodal


def test_signal_features(spark):
    left, right = [0.5, -0.5, 0.5, -0.5], [1.0, -1.0, 1.0, -1.0]
    a, b = F.array(*map(F.lit, left)), F.array(*map(F.lit, right))
    assert one(spark, signals.rms(b)) == 1 and abs(one(spark, signals.crest_db(a))) < 1e-9
    assert abs(one(spark, signals.stereo_width(a, a))) < 1e-12 and abs(one(spark, signals.stereo_imbalance(a, b)) - 0.6) < 1e-12
    assert one(spark, signals.standardised(F.array(F.lit(2.0), F.lit(2.0)))) == [0, 0]
    assert one(spark, signals.onset(F.array(*map(F.lit, [1.0, 3.0, 2.0])))) == [0, 2, 0]
    faded = one(spark, signals.faded(F.array(*[F.lit(1.0)] * 10), 3))
    assert faded[4] == 1 and faded[0] < faded[1] < 1 and math.isclose(faded[0], faded[-1])


def test_quality(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 2, None)], "g string, k int, v double")
    assert [(r.code, r.k) for r in quality.issues(df, ["k"], {"no_v": ("v", F.col("v").isNull())}).collect()] == [("no_v", 2)]
    with pytest.raises(ValueError):
        quality.require_one_to_one(df, df, "g")
    with pytest.raises(ValueError):
        tables.require(df, ["nope"])
    assert quality.population_gaps(df, spark.createDataFrame([(2,), (3,)], "k int"), ["k"]).count() == 2


def test_design(spark):
    df = spark.createDataFrame([(f"u{i}", b, s) for i in range(40) for b in "xy" for s in "pqr"], "u string, b string, s string")
    order = design.blocked_order(df, "u", "b", "s", 1)
    assert order.count() == 240 and order.where("label not in ('A', 'B', 'C')").count() == 0
    assert sorted(map(tuple, order.collect())) == sorted(map(tuple, design.blocked_order(df.repartition(7), "u", "b", "s", 1).collect()))
    kept = design.assign(spark.createDataFrame([("a",), ("b",)], "k string"), "k", ["X", "Y"], spark.createDataFrame([("a", "Y"), ("b", "gone")], "k string, assigned string"))
    assert {r.k: r.assigned for r in kept.collect()}["a"] == "Y"
    grid = design.scenario_grid(spark, {"m": 1.0}, [10, 20], 3)
    assert grid.count() == 6 and design.pending(grid, grid.limit(2), ["scenario", "participants", "repetition"]).count() == 4
    z = spark.range(4000).select(design.normal(F.col("id")).alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(z.m) < 0.1 and abs(z.s - 1) < 0.1


def test_files(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('﻿Group ID,b\n"a ""q""\nline",1\n,2\n', encoding="utf-8")
    df = files.read_strings(spark, str(p), ["group_id"], normalise=True)
    assert sorted(r.b for r in df.collect()) == ["1", "2"] and df.where("group_id like '%q%'").count() == 1
    assert files.read_or_empty(spark, str(tmp_path / "none.csv"), "a string, b int").count() == 0
    assert files.first_existing(spark, str(tmp_path), "y.csv", "x.csv").endswith("x.csv")
    assert [r.present for r in files.catalogue(spark, {"x": str(p), "z": str(tmp_path / "z")}).orderBy("name").collect()] == [True, False]
    files.write_csv(spark.createDataFrame([(1.5, float("nan"), True)], "a double, b double, c boolean"), str(tmp_path / "out"), ["a", "b", "c"])
    assert files.read_strings(spark, str(tmp_path / "out")).first().c == "true"
    files.save_unit(spark.range(3), str(tmp_path / "units"), "r1")
    assert files.saved_units(spark, str(tmp_path / "units"), "r1").count() == 3 and files.saved_units(spark, str(tmp_path / "units"), "r2").count() == 0
    assert files.manifest(spark, str(tmp_path), "*.csv").where(F.col("path").endswith("x.csv")).count() == 1
    assert files.append(spark.range(1), spark.createDataFrame([(1, "a")], "id bigint, n string")).count() == 2


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([[16384, -16384]] * 8000, dtype=np.int16).tobytes())
    (tmp_path / "broken.wav").write_bytes(b"no audio")
    got = {r.path.rpartition("/")[2]: r for r in files.read_wav(spark, str(tmp_path), 0.5).collect()}
    assert got["a.wav"].channels == 2 and len(got["a.wav"].samples[0]) == 4000 and got["a.wav"].samples[1][0] == -0.5 and got["broken.wav"].problem


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:02"), (2, "2024-01-01 00:07:00"), (3, "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "k int, t string").selectExpr("k", "timestamp(t) AS t").coalesce(1).write.parquet(src)
    stream = ingest.stream_folder(spark, src, "k int, t timestamp")
    ingest.run_available(ingest.distinct_deliveries(stream, ["k"], "t", "1 day"), str(tmp_path / "o1"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 3
    ingest.run_available(ingest.windowed_counts(stream, "t", [], "5 minutes", "1 minute"), str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination(120)
    assert sorted(r.rows for r in spark.read.parquet(str(tmp_path / "o2")).collect()) == [1, 2]
