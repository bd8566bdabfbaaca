"""Session checks, orders, answers, designs, report contexts and Bark spectra on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from tonelake.operators import design, sessions, signals


def test_session_checks(spark):
    rows = [("ok", t, k, 5) for t in (1, 2) for k in "AB"] + [("twice", 1, "A", 5), ("twice", 1, "A", 5), ("unrated", 1, "A", None), ("unrated", 1, "B", 5)]
    df = spark.createDataFrame(rows, "s string, t int, label string, rating int")
    got = {r.s: r for r in sessions.session_checks(df, "s", "t", {"rated": F.col("rating") >= 0}, {"labels": F.count_distinct("label") == 2}, 2).collect()}
    assert got["ok"].accepted and got["ok"].responses == 4
    assert not got["twice"].labels and got["twice"].rated and not got["twice"].trial_count and not got["twice"].accepted
    assert not got["unrated"].rated and got["unrated"].labels
    assert sessions.session_checks(df.limit(0), "s", "t", {}, {}).count() == 0


def test_order_checks(spark):
    rows = [("a", 1, "E1", "x"), ("a", 2, "E1", "y"), ("a", 3, "E2", "x"), ("a", 4, "E2", "y"), ("b", 1, "E1", "x"), ("b", 2, "E2", "x"), ("b", 3, "E1", "y"), ("c", 1, "E1", "x"), ("c", 2, "E1", "x")]
    got = {r.s: r for r in sessions.order_checks(spark.createDataFrame(rows, "s string, t int, e string, i string"), "s", "t", "e", "i", 2).collect()}
    assert got["a"].contiguous and got["a"].per_block and got["a"].items_once
    assert not got["b"].contiguous and not got["b"].per_block and got["c"].contiguous and not got["c"].items_once


def test_orders_are_not_grouped_and_fair(spark):
    units = spark.range(200).select(F.col("id").cast("string").alias("unit"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("segment"))
    got = {}
    for r in sessions.ungrouped_order(units, "unit", "segment", 3).orderBy("unit", "position").collect():
        got.setdefault(r.unit, []).append(r.segment)
    assert len(got) == 200 and all(sorted(v) == list("aaabbb") and v not in (list("aaabbb"), list("bbbaaa")) for v in got.values())
    # no order of one repeat each is mixed: the segments take turns
    assert all(r.attempt == 0 for r in sessions.ungrouped_order(units, "unit", "segment", 1).collect())
    drawn = design.blocked_order(units.select("unit", F.lit("x").alias("block"), F.col("segment").alias("item")), "unit", "block", "item", 3)
    audit = sessions.randomisation_audit(drawn, "item", "item_position").collect()
    assert len(audit) == 4 and sum(r.times for r in audit) == 400 and all(r.expected == 0.5 and r.deviation < 0.12 for r in audit)


def test_answers(spark):
    rows = [(1, {"age": "30", "gear": "Other ", "gear_detail": "horn"}), (2, {"age": " ", "gear": "other"}), (3, {"gear": None, "timing.start": "5", "timing.end": " ", "x": "1"})]
    df = spark.createDataFrame(rows, "u int, answers map<string,string>")
    assert sorted(map(tuple, sessions.missing_answers(df, "u", [("age", True, None), ("gear", True, "gear_detail")]).collect())) == [(2, "age"), (2, "gear_detail"), (3, "age"), (3, "gear")]
    kept = df.select("u", sessions.allowed_answers(F.col("answers"), {"gear": ["Other "]}, {"gear": ["gear_detail"]}).alias("a"), sessions.with_prefix(F.col("answers"), "timing.").alias("t")).collect()
    assert kept[0].a["gear_detail"] == "horn" and kept[1].a == {"age": " "} and kept[2].t == {"timing.start": "5"}


def test_screening(spark):
    rows = [("a", 1, "q1", 0), ("a", 2, "q1", 1), ("a", 2, "q2", 1), ("a", 2, "q2", 0), ("b", 1, "q1", None), ("b", 1, "q2", 1)]
    got = {r.u: (r.score, r.passed) for r in sessions.passed_screening(spark.createDataFrame(rows, "u string, n int, q string, s int"), "u", "n", "q", "s", 2).collect()}
    assert got == {"a": (2, True), "b": (1, False)}


def test_report_context(spark):
    a, b = spark.createDataFrame([(1, "x", "PASS"), (2, "y", "ODD")], "k int, n string, s string"), spark.createDataFrame([(1, "z")], "k int, n string")
    got = {r.k: r.problems for r in sessions.report_context({"a": a, "b": b}, ["k"], {"names": ("a_n", "b_n")}, {"a_s": ["PASS"]}).collect()}
    assert got == {1: "names", 2: "b_missing;names;a_s_illegal"}


def test_designs(spark):
    s = spark.createDataFrame([("g1", "s1", f"a{k}") for k in range(3)] + [("g2", "s2", f"b{k}") for k in range(2)] + [(None, "s3", "c")], "grp string, song string, item string")
    rows = design.full_design(spark, 5, s, "grp", "song", "item", ["E1", "E2"], 1).collect()
    assert len(rows) == 3 * 2 * 3 + 2 * 2 * 2 and {r.grp for r in rows if r.participant == 1} == {"g1"}
    for p in (1, 2):
        one = [r for r in rows if r.participant == p and r.episode == "E1"]
        assert sorted(r.position for r in one) == list(range(1, len(one) + 1)) and len({r.item for r in one}) == len(one)
    assert design.group_split(5) == (3, 2) and design.group_split(5, odd_first=False) == (2, 2)


def test_bark_spectra(spark):
    rate, t = 44_100, np.arange(40_000) / 44_100
    tone = np.sin(2 * np.pi * 1000 * t)
    got = signals.bark_spectrum(tone, tone, rate)
    filters = signals.bark_filters(rate, 32_768)
    want = int(np.argmax(filters[:, round(1000 * 32_768 / rate)]))
    assert got.shape == (48,) and int(np.argmax(got[:24])) == want and np.allclose(got[24:], np.log(1e-8))  # nothing in the side signal
    assert int(np.argmax(signals.bark_spectrum(tone, -tone, rate)[24:])) == want
    df = spark.createDataFrame([("a", [0.0, 1.0], [0.0, 1.0]), ("b", None, [1.0]), ("c", [1.0], [])], "k string, l array<double>, r array<double>")
    rows = {r.key: r.bark for r in signals.bark_spectra(df, "k", "l", "r", 8000, 64, 16).collect()}
    assert len(rows["a"]) == 48 and rows["b"] is None and rows["c"] is None


def test_separated_pairs(spark):
    m = spark.createDataFrame([("g", 1, [0.0, 0.0, 0.0]), ("g", 2, [1.0, -3.0, 2.0])], "grp string, idx int, x array<double>")
    r = sessions.separated_pairs(spark.createDataFrame([("g", 1, 2, 3.7)], "grp string, i int, j int, d double"), m, ["a", "b", "c"]).first()
    assert r.differing == "b, c" and r.rank == 1
