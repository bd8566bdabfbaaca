"""Pools, stratification, submissions, excerpts, summaries and packages on small fixtures and against brute force."""

import io
import json
import math
import random
import wave
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.functions import numeric, text
from tonelake.operators import combos, excerpts, nested, pools, ranking, responses, signals, summaries, vectors
from tonelake.sources import files, packages, tables


# combined space and pools


def brute_space(scalars, spectrum):
    def scale(x):
        q1, m, q3 = np.percentile(x, [25, 50, 75], axis=0)
        return np.array([[0.0 if b - a <= 1e-10 else (v - c) / (b - a) for v, a, c, b in zip(row, q1, m, q3)] for row in x])

    s, b = scale(scalars), scale(spectrum)
    b = b[:, b.var(axis=0) > 1e-12]
    values, axes = np.linalg.eigh(np.cov(b.T))
    order = np.argsort(values)[::-1][: min(len(b) - 1, b.shape[1])]
    ratio = values[order] / values[order].sum()
    kept = next(k for k in range(1, len(ratio) + 1) if ratio[:k].sum() >= 0.95 - 1e-12)
    scores = (b - b.mean(axis=0)) @ axes[:, order[:kept]]
    weigh = lambda x: x / math.sqrt((x**2).sum(axis=1).mean())
    return s, scores, np.hstack([weigh(s), weigh(scores)])


def pool_rows(seed=3, n=12):
    rng = np.random.default_rng(seed)
    return [("g", f"m{k:02}", [float(v) for v in rng.normal(size=4)], [float(v) for v in rng.normal(size=6) * np.arange(1, 7)], f"i{k % 3}") for k in range(n)]


def test_combined_space_by_brute_force(spark):
    rows = pool_rows()
    df = spark.createDataFrame(rows, "grp string, member string, scalars array<double>, spectrum array<double>, institution string")
    s, scores, x = brute_space(np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r.i, r.j): r for r in pools.combined_edges(df).collect()}
    assert len(got) == 66 and all(abs(got[i + 1, j + 1].combined - d[i, j]) < 1e-9 for i, j in combinations(range(12), 2))
    m = int(np.argmin(d.sum(axis=1)))
    out = {r.member: r for r in pools.outliers(df).collect()}
    centre = np.sqrt(((scores - np.median(scores, axis=0)) ** 2).sum(axis=1))
    for k in range(12):
        want = np.abs(s[k]).max() + centre[k] / np.median(centre[centre > 0]) + d[k, m] / np.median(d[d[:, m] > 0, m])
        assert abs(out[f"m{k:02}"].score - want) < 1e-6
        assert abs(out[f"m{k:02}"].nearest - min(d[k, j] for j in range(12) if j != k)) < 1e-9
    best = max((c for c in combinations(range(12), 3) if m in c and len({k % 3 for k in c}) >= 2), key=lambda c: (round(min(d[a, b] for a, b in combinations(c, 2)), 9), round(np.mean([d[a, b] for a, b in combinations(c, 2)]), 9)))
    assert pools.best_subset(df).first().members == "|".join(f"m{k:02}" for k in best)
    methods = {r.method: r for r in pools.pool_methods(df, 4).collect()}
    chosen = [int(x[1:]) for x in methods["farthest_point"].members.split("|")]
    assert methods["farthest_point"].stability == 1 and abs(methods["farthest_point"].least - min(d[a, b] for a, b in combinations(chosen, 2))) < 1e-6
    assert pools.pools(df, 20).count() == 12 and pools.pools(df.limit(0), 3).count() == 0
    one = pools.outliers(df.limit(1)).first()
    assert one.score == 0 and pools.combined_edges(df.limit(1)).count() == 0


def farthest_by_words(d, size, near):
    """The pool rule, one candidate at a time."""
    chosen = [min(range(len(d)), key=lambda k: (round(sum(d[k]), 9), k))]
    while len(chosen) < min(size, len(d)):
        def rank(k):
            least = min(d[k][c] for c in chosen)
            if len(chosen) + 1 < size and any(near[k][c] for c in chosen):
                least = -1.0
            return (round(least, 9), round(sum(d[k][c] for c in chosen) / len(chosen), 9), -k)

        chosen.append(max((k for k in range(len(d)) if k not in chosen), key=rank))
    return chosen


def test_farthest_pool_with_near_duplicates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        for size in (1, 3, 5, 20):
            x = rng.integers(0, 4, size=(n, 2)).astype(float)
            d = pools.distances(x)
            near = (d <= 1) & ~np.eye(n, dtype=bool)
            assert pools.farthest(d, size, near) == farthest_by_words(d.tolist(), size, near.tolist())
    # the last place is open to near duplicates, the ones before are not
    d = pools.distances(np.array([[0.0], [0.1], [10.0], [10.2], [4.9]]))
    near = (d < 0.5) & ~np.eye(5, dtype=bool)
    assert pools.farthest(d, 3, near)[:2] == [4, 3]


def test_medoids_cannot_be_bettered_by_an_exchange():
    rng = np.random.default_rng(2)
    d = pools.distances(rng.normal(size=(20, 3)))
    at = pools.swapped_medoids(d, 4)
    cost = d[:, at].min(axis=1).sum()
    assert len(set(at)) == 4 and all(d[:, at[:a] + [k] + at[a + 1 :]].min(axis=1).sum() >= cost - 1e-9 for a in range(4) for k in range(20) if k not in at)
    with pytest.raises(ValueError, match="stereo_imbalance"):
        pools.forbid(["rms", "scaled_stereo_imbalance"], "stereo_imbalance")


def test_quality_flags_and_listed_pairs(spark):
    rows = [(*r[:4], [f"m{k + 1:02}"] if k == 0 else []) for k, r in enumerate(pool_rows())] + [("g", "x", [50.0, 0.0, 0.0, 0.0], [0.0] * 6, None)]
    df = spark.createDataFrame(rows, "grp string, member string, scalars array<double>, spectrum array<double>, listed array<string>")
    got = {r.member: r.flags for r in pools.quality_flags(df, ["a", "b", "c", "d"]).collect()}
    assert "extreme_a" in got["x"] and "near_duplicate" in got["m00"] and "near_duplicate" in got["m01"]


# stratification


def test_triples_by_hand(spark):
    e = spark.createDataFrame([("g", 1, 2, 3.0), ("g", 1, 3, 3.0), ("g", 2, 3, 3.0), ("g", 1, 4, 1.0), ("g", 2, 4, 2.0), ("g", 3, 4, 3.0)], "grp string, i int, j int, d double")
    s = spark.createDataFrame([("g", 1, "a", 0.1, "clear"), ("g", 2, "b", 0.5, "review"), ("g", 3, "c", 0.9, "caution"), ("g", 4, "d", 0.5, "clear")], "grp string, idx int, name string, score double, status string")
    t = combos.with_tertiles(s)
    # thirds of .1 .5 .5 .9 lie at .5 and .5: both limits belong to the outer thirds, the lower one first
    assert {r.name: r.third for r in t.collect()} == {"a": 0, "b": 0, "c": 2, "d": 0}
    got = {(r.names, r.condition): r for r in combos.ranked(combos.triple_objective(combos.triples(e), t)).collect()}
    # a|b|c: least 3 and mean 3 are the greatest, spread .8 too: .8 * 1 + .2 * 1 - .05 - .025
    assert abs(got["a|b|c", "wide"].objective - 0.925) < 1e-9 and abs(got["a|b|c", "similar"].objective - 0.725) < 1e-9
    assert [got[n, "wide"].number for n in ("a|b|c", "a|b|d", "a|c|d", "b|c|d")] == [1, 2, 3, 4]
    # b|c|d: least 2, mean 8/3, spread .4 of (.4 .. .8): 0 wide
    assert abs(got["b|c|d", "wide"].objective - (0.8 * (0.7 * 0.5 + 0.3 * 2 / 3) - 0.075)) < 1e-9
    ties = spark.createDataFrame([("g", "wide", 1.0, 1.0, 1.0, n) for n in ("a|b", "c|d", "b|z")], "grp string, condition string, objective double, min_d double, mean_d double, names string")
    assert [r.names for r in combos.ranked(ties).orderBy("rank").collect()] == ["c|d", "b|z", "a|b"]


def test_three_thirds_give_a_bonus(spark):
    e = spark.createDataFrame([("g", i, j, 1.0) for i, j in combinations(range(1, 4), 2)], "grp string, i int, j int, d double")
    s = spark.createDataFrame([("g", k, n, v, "clear") for k, n, v in ((1, "a", 0.0), (2, "b", 0.5), (3, "c", 1.0))], "grp string, idx int, name string, score double, status string")
    got = {r.condition: r.objective for r in combos.triple_objective(combos.triples(e), combos.with_tertiles(s)).collect()}
    assert abs(got["wide"] - 0.03) < 1e-9 and abs(got["similar"] - 0.2) < 1e-9  # flat distances and spreads count 0


def test_five_of_six_by_closest_triple(spark):
    names = list("abcdef")
    ratings = dict(zip(names, (0.10, 0.13, 0.17, 0.50, 0.70, 0.95)))
    long = spark.createDataFrame([("s", o, m) for o in names for m in names if m != o], "set string, left_out string, member string")
    pairs = spark.createDataFrame([("s", m, n, 1.0 + abs(ord(m) - ord(n))) for m, n in combinations(names, 2)], "set string, m string, n string, d double")
    got = {r.left_out: r for r in combos.subset_scores(long, "set", pairs, spark.createDataFrame(list(ratings.items()), "member string, rating double"), 2.0).collect()}
    for o in names:
        v = sorted(ratings[m] for m in names if m != o)
        triple, pair = min(v[k + 2] - v[k] for k in range(3)), min(v[k + 1] - v[k] for k in range(4))
        want = 1.0 if triple <= 0.08 else max(0.0, 1 - pair / 0.18)
        assert abs(got[o].similarity - want) < 1e-9
    # without a, the closest pair is within .08 but no triple is: the pair's fall decides
    assert abs(got["a"].similarity - (1 - 0.04 / 0.18)) < 1e-9 and got["f"].similarity == 1
    assert sorted(r.rank for r in got.values()) == [1, 2, 3, 4, 5, 6] and got["a"].near_pairs == 4


def test_six_members(spark):
    rows = [("g", "similar", 1, "a|b|c", 1.0, 1.0), ("g", "wide", 1, "a|b|d", 0.9, 1.0), ("g", "wide", 2, "d|e|f", 0.5, 1.0)]
    r = spark.createDataFrame(rows, "grp string, condition string, rank int, names string, objective double, min_d double")
    assert combos.six_members(r, disjoint=True).first().members == list("abcdef")
    with pytest.raises(ValueError, match="share"):
        combos.six_members(r.where("rank = 1"), disjoint=True)


# submissions


def plain_issues(rows):
    """The checks of one table of submissions, row by row."""
    out = []
    studies = [r["study_id"] or "" for r in rows]

    def parse(cell):
        try:
            return json.loads(cell) if cell else None
        except ValueError:
            return None

    text_of = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v)
    for r in rows:
        add = lambda field, code, place="": out.append((r["submission_row_id"], place, field, code))
        if not r["study_id"]:
            add("study_id", "missing_study_id")
        elif studies.count(r["study_id"]) > 1:
            add("study_id", "duplicate_study_id")
        cells = {c: parse(r[c]) for c in r if c.endswith("_json")}
        for c in cells:
            if not r[c]:
                if c == "responses_json":
                    add(c, "missing_json")
            elif cells[c] is None and r[c].strip() != "null":
                add(c, "malformed_json")
        got = cells["responses_json"]
        if not isinstance(got, list):
            add("responses_json", "responses_not_list")
            continue
        client = cells["client_validation_json"]
        if isinstance(client, dict):
            e, a = client.get("expected_response_count"), client.get("actual_response_count")
            if type(a) is int and a != len(got):
                add("client_validation_json", "expected_actual_mismatch")
            if type(a) is int and type(e) is int and e != a:
                add("client_validation_json", "expected_actual_mismatch")
        assigned = [v for v in cells["assigned_song_ids_json"] or [] if isinstance(v, str)] if isinstance(cells["assigned_song_ids_json"], list) else []
        mapping = cells["mix_mapping_json"] if isinstance(cells["mix_mapping_json"], dict) else {}
        episodes = {v for v in cells["episode_order_json"] or [] if isinstance(v, str)} | set(mapping)
        order = cells["presentation_order_json"] if isinstance(cells["presentation_order_json"], dict) else {}
        seen, trials = set(), {}
        for n, x in enumerate(got, 1):
            if not isinstance(x, dict):
                add("responses_json", "response_not_object", str(n))
                continue
            ep, sc = text_of(x.get("episode_id")), text_of(x.get("scenario_id"))
            v = {k: text_of(x.get(k)) for k in ("trial_index", "song_id", "display_label", "stimulus_id", "rating")} | {"episode_id": ep or sc, "comparative_comment": text_of(x.get("comparative_comment")) or text_of(x.get("comment"))}
            for f in ("episode_id", "song_id", "display_label", "stimulus_id", "rating", "comparative_comment"):
                if not v[f]:
                    add(f, "missing_stimulus_id" if f == "stimulus_id" else "missing_response_field", str(n))
            if type(x.get("rating")) is not int or not 0 <= x["rating"] <= 100:
                add("rating", "rating_not_integer_0_100", str(n))
            if assigned and v["song_id"] not in assigned:
                add("song_id", "unassigned_song_id", str(n))
            if episodes and v["episode_id"] not in episodes:
                add("episode_id", "invalid_episode_id", str(n))
            m = mapping.get(v["episode_id"])
            m = m.get(v["song_id"]) if isinstance(m, dict) else None
            labels = {k: (w.get("stimulus_id") if isinstance(w, dict) else w) for k, w in m.items() if w is None or isinstance(w, (str, dict))} if isinstance(m, dict) else {}
            mapped = labels.get(v["display_label"]) or None
            if not mapped:
                add("display_label", "missing_mix_mapping", str(n))
            elif v["stimulus_id"] and mapped != v["stimulus_id"]:
                add("stimulus_id", "mapping_response_disagreement", str(n))
            key = (v["trial_index"], v["episode_id"], v["song_id"], v["display_label"])
            if key in seen:
                add("responses_json", "duplicate_response_within_trial", str(n))
            seen.add(key)
            position = text_of(x.get("display_position"))
            trials.setdefault(key[:3], []).append((int(position) if position.isdigit() else 999_999, v["display_label"], v["comparative_comment"], labels))
        for (trial, ep, song), shown in trials.items():
            shown.sort(key=lambda s: s[:2])
            names = [s[1] for s in shown]
            exported = order.get(ep)
            exported = exported.get(song) if isinstance(exported, dict) else None
            if exported and names != exported:
                add("presentation_order_json", "presentation_order_disagreement", f"trial_{trial}")
            if shown[0][3] and sorted(shown[0][3]) != sorted(set(names)):
                add("mix_mapping_json", "unexpected_mix_count", f"trial_{trial}")
            if len({s[2] for s in shown if s[2].strip()}) != 1:
                add("comparative_comment", "inconsistent_trial_comments", f"trial_{trial}")
    return sorted(out)


def submission(row_id, study="s", **cells):
    versions = [{"trial_index": 1, "episode_id": "E1", "song_id": "g", "display_label": k, "display_position": p, "stimulus_id": f"st{k}", "rating": 50, "comparative_comment": "so"} for p, k in enumerate("AB", 1)]
    base = {"responses_json": versions, "client_validation_json": {"expected_response_count": 2, "actual_response_count": 2}, "assigned_song_ids_json": ["g"], "episode_order_json": ["E1"], "mix_mapping_json": {"E1": {"g": {"A": "stA", "B": {"stimulus_id": "stB"}}}}, "presentation_order_json": {"E1": {"g": ["A", "B"]}}}
    change = {k: v(base[k]) if callable(v) else v for k, v in cells.items()}
    return {"submission_row_id": row_id, "study_id": study, **{k: (v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in {**base, **change}.items()}}


def test_every_issue_code(spark):
    put = lambda n, **kw: lambda v: [{**x, **kw} if k == n else x for k, x in enumerate(v)]
    rows = [
        submission(1, "clean"), submission(2, None), submission(3, "twice"), submission(4, "twice"), submission(5, "a", responses_json=None), submission(6, "b", responses_json="{bad"), submission(7, "c", responses_json={}),
        submission(8, "d", responses_json=lambda v: [*v, 5, None, [1]]), submission(9, "e", responses_json=put(0, stimulus_id=None)), submission(10, "f", responses_json=put(1, comparative_comment="")), submission(11, "g", responses_json=put(0, rating="50")),
        submission(12, "h", responses_json=put(0, rating=101)), submission(13, "i", responses_json=put(0, rating=True)), submission(14, "j", assigned_song_ids_json=["other"]), submission(15, "k", episode_order_json=["E9"], mix_mapping_json={"E9": {}}),
        submission(16, "l", mix_mapping_json={"E1": {"g": {"A": "stA"}}}), submission(17, "m", mix_mapping_json={"E1": {"g": {"A": "x", "B": "stB"}}}), submission(18, "n", responses_json=lambda v: [*v, v[1]]), submission(19, "o", client_validation_json={"expected_response_count": 3, "actual_response_count": 4}),
        submission(20, "p", presentation_order_json={"E1": {"g": ["B", "A"]}}), submission(21, "q", responses_json=put(1, comparative_comment="other")), submission(22, "r", mix_mapping_json="nope"), submission(23, "t", responses_json=put(0, episode_id="", scenario_id="E1")), submission(24, "u", responses_json=put(0, display_position="x")),
        submission(25, "v", responses_json=[]), submission(26, "w", assigned_song_ids_json=None, episode_order_json=None, mix_mapping_json=None, presentation_order_json=None, client_validation_json=None),
    ]
    columns = list(rows[0])
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} {'bigint' if c == 'submission_row_id' else 'string'}" for c in columns)).withColumn("path", F.lit(1))
    s = responses.Submissions(df)
    got = sorted(tuple(r) for r in s.issues().select("row_id", "place", "field", "code").collect())
    assert got == plain_issues(rows)
    codes = {g[3] for g in got}
    assert codes >= {"missing_study_id", "duplicate_study_id", "missing_json", "malformed_json", "responses_not_list", "response_not_object", "missing_stimulus_id", "missing_response_field", "rating_not_integer_0_100", "unassigned_song_id", "invalid_episode_id", "missing_mix_mapping", "mapping_response_disagreement", "duplicate_response_within_trial", "expected_actual_mismatch", "presentation_order_disagreement", "unexpected_mix_count", "inconsistent_trial_comments"}
    trials = {r.row_id: r for r in s.trials().collect()}
    assert trials[1].status == "valid" and trials[1].labels == ["A", "B"] and trials[24].labels == ["B", "A"] and "duplicate display label" in trials[18].notes
    counted = {r.name: r.value for r in responses.report(s, s.issues(), F.lit(True)).collect()}
    assert counted["submissions"] == 26 and counted["unique_study_ids"] == 24 and counted["passed"] == 0 and counted["issues_duplicate_study_id"] == 2
    assert responses.Submissions(df.limit(0)).issues().count() == 0
    assert sorted(r.row_id for r in responses.numeric_rating_issues(s.responses).collect()) == [11, 13]


def test_submissions_of_the_test_tables(spark):
    from compare import DATA, have_data

    if not have_data():
        pytest.skip("no test tables here")
    df = tables.table(spark, DATA, "submissions")
    rows = [r.asDict() for r in df.select("submission_row_id", "study_id", *(c for c in df.columns if c.endswith("_json") and c != "trial_records_json")).collect()]
    strict = lambda r: all(not r[c] or "NaN" not in r[c] for c in r if c.endswith("_json"))
    got = sorted(tuple(r) for r in responses.Submissions(df).issues().select("row_id", "place", "field", "code").collect())
    want = plain_issues([{k: (v.strip() if isinstance(v, str) and k.endswith("_json") else v) for k, v in r.items()} for r in rows])
    keep = {r["submission_row_id"] for r in rows if strict(r)}
    assert [g for g in got if g[0] in keep] == [w for w in want if w[0] in keep]


def test_columns_by_name_and_content(spark):
    df = spark.createDataFrame([("1", '{"a":1}', "[1", "x", " "), ("2", " [2]", "y", "z", None)], "id string, cell string, mixed string, extra_json string, empty string")
    assert responses.json_columns(df) == ["cell", "extra_json"]
    assert responses.privacy_columns(["ip", "User_Agent", "tip", "useragent2", "client_ip"]) == ["ip", "User_Agent", "useragent2", "client_ip"]


# excerpts and signals


def test_window_scores_by_brute_force(spark):
    rng = random.Random(4)
    activity = [(float(t) / 2, *(float(rng.random() < 0.5) for _ in range(4))) for t in range(120)]
    df = spark.createDataFrame(activity, "at double, bass double, drums double, other double, vocal double")
    w = spark.createDataFrame([(1, 5.0), (2, 20.25), (3, 500.0)], "candidate_rank int, start double")
    groups = ["bass", "drums", "other", "vocal"]
    got = {r.candidate_rank: r for r in excerpts.boundary_quality(excerpts.window_coverage(w, df, 10.0, groups), df, 10.0, groups).collect()}
    for k, s in ((1, 5.0), (2, 20.25)):
        inside = [a for a in activity if s <= a[0] < s + 10]
        assert abs(got[k].vocal - np.mean([a[4] for a in inside])) < 1e-9 and abs(got[k].core - np.mean([a[4] * a[1] * a[2] for a in inside])) < 1e-9
        q = 1.0
        for edge in (s, s + 10):
            near = [sum(a[1:]) > 0 for a in activity if edge - 0.75 <= a[0] <= edge + 0.75]
            inner = [sum(a[1:]) > 0 for a in activity if edge + 0.75 <= a[0] <= edge + 2]
            q *= max(0, min(1, 1 - 0.35 * abs(np.mean(near) - (np.mean(inner) if inner else np.mean(near)))))
        assert abs(got[k].boundary - q) < 1e-9
    assert got[3].vocal == 0 and got[3].boundary == 1
    assert excerpts.shifted(w, "start").count() == 39


def test_technical_checks_by_hand(spark):
    t = np.linspace(0, 6, 200)
    left, right = 0.5 * np.sin(5 * t), 0.5 * np.cos(5 * t)
    rows = [("plain", left, right), ("clip", np.r_[left[:-1], 1.0], right), ("mono", left, left), ("loud", left, right / 10), ("flat", np.zeros(200), right), ("opposed", left, -left)]
    df = spark.createDataFrame([(n, a.tolist(), b.tolist()) for n, a, b in rows], "id string, l array<double>, r array<double>")
    got = {r.id: r for r in excerpts.technical_checks(df, "l", "r", F.lit(False), F.lit(True)).collect()}
    assert got["clip"].status == "FAIL" and got["clip"].clipped == 1 and got["clip"].near_clipped == 1
    assert got["mono"].reasons == "mono_duplicate_channels" and got["loud"].reasons.startswith("severe_channel_energy_difference") and got["opposed"].status == "PASS"
    for n, a, b in rows:
        want = np.corrcoef(a, b)[0, 1] if a.std() > 1e-9 and b.std() > 1e-9 else 0.0
        assert abs(got[n].phase - want) < 1e-9
    assert "phase_correlation_review" in got["flat"].reasons
    p = df.select("id", excerpts.probe(F.col("l")).alias("p"), excerpts.discontinuity(F.col("l"), 3).alias("step"), excerpts.linear_faded(F.col("l"), 500, 10).alias("f"), excerpts.active_curve(F.transform("l", F.abs)).alias("a")).collect()
    by = {r.id: r for r in p}
    assert by["flat"].p.near_silent and by["clip"].p.clipping and by["plain"].p.finite and not by["plain"].p.clipping
    assert abs(by["plain"].step - np.abs(np.diff(left[:5])).max()) < 1e-12 and by["plain"].f[0] == 0 and by["plain"].f[10] == left[10]
    lo, hi = np.percentile(np.abs(left), [20, 70])
    assert by["plain"].a == [1.0 if v > lo + 0.2 * (hi - lo) else 0.0 for v in np.abs(left)]
    e = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (-1, [1.0]), (0, None)], "s int, a array<double>")
    assert [tuple(r) for r in e.select(excerpts.excerpt(F.col("a"), F.col("s"), 2), excerpts.excerpt_error(F.col("a"), F.col("s"), 2)).collect()] == [([1.0, 2.0], None), (None, "ends_after_signal"), (None, "starts_before_signal"), (None, "no_signal")]


def test_lag_refinement(spark):
    x = [math.sin(k * k / 40) for k in range(120)]
    a = spark.createDataFrame([(k, x[k]) for k in range(100)], "t int, v double")
    b = spark.createDataFrame([(k + 7, x[k]) for k in range(100)], "t int, v double")
    assert excerpts.refined_lag(a, b, "t", "v", 5, 4).first().lag == 7


# summaries


def test_recommended_size_falls_back(spark):
    def size(rows):
        r = summaries.recommended_size(spark.createDataFrame(rows, "s string, n int, p boolean"), "s", "n", "p").first()
        return r["size"], r.rule

    grid = lambda good: [(s, n, (s, n) in good) for s in "abc" for n in (10, 20, 30)]
    assert size(grid({(s, 20) for s in "abc"} | {("a", 10)})) == (20, "all_scenarios")
    assert size(grid({("a", 10), ("a", 20), ("b", 20)})) == (20, "most_scenarios")
    assert size(grid({("a", 10)})) == (30, "greatest_size")


def test_assertions_and_lookups(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "k int, v string")
    summaries.require_subset(a, b, ["k"])
    with pytest.raises(ValueError):
        summaries.require_population(a, b, ["k"])
    with pytest.raises(ValueError):
        summaries.require_keys(a.unionByName(a), ["k"])
    got = summaries.lookup_all(a, {"names": b}, ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "x", "p"), (2, "y", "q")] and got.columns == ["k", "v", "names_v"]
    with pytest.raises(ValueError, match="names"):
        summaries.lookup_all(b, {"names": a}, ["k"])
    assert summaries.all_within(a, "k", 1, 2) and not summaries.all_within(a, "k", 2, 3) and summaries.all_within(a.limit(0), "k", 5, 6)


def test_prediction_checks(spark):
    df = spark.createDataFrame([("ok", 0.5), ("ok", 0.3), ("ok", 0.2), ("tie", 0.5), ("tie", 0.5), ("bad", 1.5), ("bad", -0.5), ("bad", 0.0)], "g string, p double")
    got = {(r.g, r.check): r.passed for r in summaries.prediction_checks(df, "g", "p").collect()}
    assert all(got["ok", c] for c in ("candidates", "within_0_1", "adds_up_to_1", "one_winner"))
    assert not got["tie", "candidates"] and not got["tie", "one_winner"] and not got["bad", "within_0_1"] and got["bad", "adds_up_to_1"]


# names, configuration, packages


def test_names(spark):
    df = spark.createDataFrame([("Mix One", "m1", "kick in"), ("Two", " ", "BLACK vox"), (None, "m3", "Lead Vox 2")], "n string, i string, t string")
    rules = [("vox|vocal", "vocal", "high"), ("kick|snare", "drums", "medium")]
    got = df.select(text.display_label(F.col("n"), F.col("i")).alias("l"), text.grouped_name(F.col("t"), rules, "black").alias("g"), text.extension(F.lit("..WAV")).alias("e"), numeric.parse_double(F.col("i"), 2.0).alias("d")).collect()
    assert [r.l for r in got] == ["Mix One (m1)", "Two", None] and [r.g and r.g.group for r in got] == ["drums", None, "vocal"] and got[0].e == ".wav" and got[0].d == 2.0


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("paths:\n  audio: ../audio\nweights: {a: 2}\n", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"paths": {"audio": "/abs"}}', encoding="utf-8")
    got = packages.load_config(str(tmp_path / "c.yaml"), {"weights": {"a": 1, "b": 3}, "n": 5}, ("paths.audio",))
    assert got["weights"] == {"a": 2, "b": 3} and got["n"] == 5 and got["paths"]["audio"] == str(tmp_path.parent / "audio")
    assert packages.load_config(str(tmp_path / "c.json"), paths=("paths.audio",))["paths"]["audio"] == "/abs"
    assert packages.run_hash({"b": 1, "a": 2}) == packages.run_hash({"a": 2, "b": 1}) and len(packages.run_hash({})) == 16


def test_packages_and_protected_outputs(spark, tmp_path):
    root = tmp_path / "out"
    (root / "archive").mkdir(parents=True)
    (root / "a.txt").write_text("one")
    (root / "archive" / "old.txt").write_text("old")
    before = spark.createDataFrame(files.manifest(spark, str(root)).collect())
    assert before.count() == 2
    listed = packages.package(str(root), str(tmp_path / "p.zip"))
    first = (tmp_path / "p.zip").read_bytes()
    packages.package(str(root), str(tmp_path / "p.zip"))
    assert [x[:2] for x in listed] == [("a.txt", 3)] and (tmp_path / "p.zip").read_bytes() == first
    assert [r.path.rsplit("/", 1)[1] for r in packages.listing(spark, str(root)).collect()] == ["a.txt"]
    assert packages.changed_files(before, files.manifest(spark, str(root))).count() == 0
    (root / "a.txt").write_text("two")
    assert packages.changed_files(before, files.manifest(spark, str(root))).count() == 1


def test_runs_by_configuration(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([(1, 2.0)], "unit int, v double")
    assert packages.saved_run(spark, path, "r", {"a": 1}) is None
    packages.save_run(df, path, "r", {"a": 1})
    packages.save_run(df, path, "r", {"a": 2})
    assert packages.saved_run(spark, path, "r", {"a": 1}).count() == 1 and packages.saved_run(spark, path, "s", {"a": 1}).count() == 0


def test_update_table(spark, tmp_path):
    spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, h string, z int").write.parquet(str(tmp_path / "t"))
    packages.update_table(spark, str(tmp_path / "t"), spark.createDataFrame([(2, None, True)], "k int, h string, ok boolean"), ["k"], str(tmp_path / "u"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "u")).collect())) == [(1, "a", 5, None), (2, None, 6, True)]
    with pytest.raises(ValueError):
        packages.update_table(spark, str(tmp_path / "t"), spark.createDataFrame([(3, "c")], "k int, h string"), ["k"], str(tmp_path / "v"))


def test_wave_files(tmp_path):
    x = np.array([[0.0, 0.5, -0.5, 2.0], [0.25, -1.5, 0.0, 0.125]])
    for bits, step in ((16, 2**-14), (24, 2**-21), (32, 1e-7)):
        rate, got = files.decode_wav(packages.encode_wav(x, 8000, bits))
        assert rate == 8000 and np.abs(got - np.clip(x, -1, 1)).max() < step
    assert files.decode_wav(packages.encode_wav(x, 8000, 32), 2 / 8000)[1].shape == (2, 2)
    with wave.open(io.BytesIO(packages.encode_wav(x, 8000, 24))) as w:
        assert w.getsampwidth() == 3
    with pytest.raises(ValueError):
        packages.decode_float_wav(b"RIFF....WAVEdata")
    t = np.arange(4000) / 8000
    up = packages.resampled(np.sin(2 * np.pi * 200 * t), 8000, 12_000)
    assert len(up) == 6000 and np.abs(up[300:-300] - np.sin(2 * np.pi * 200 * np.arange(6000) / 12_000)[300:-300]).max() < 0.01


def test_distributed_row_numbers(spark):
    rng = random.Random(8)
    rows = [("hot", rng.randrange(500) / 10) for _ in range(3000)] + [(f"g{k % 40}", float(k)) for k in range(200)] + [(None, 1.0), ("hot", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for parts in ("3", "16"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {}
            for r in ranking.numbered(df, "g", ["v"]).collect():
                got.setdefault(r.g, []).append((r.row, r.v, r.rows))
            q = {(r.g, r.share): r["quantile"] for r in ranking.exact_quantiles(df, "g", "v", [0.0, 0.1, 0.5, 1.0]).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert None not in got and len(got) == 41
        for g, found in got.items():
            values = sorted(v for k, v in rows if k == g)
            assert [(i, v) for i, v, _ in sorted(found)] == list(enumerate(values, 1)) and {n for _, _, n in found} == {len(values)}
            assert all(abs(q[g, p] - np.quantile(values, p)) < 1e-9 for p in (0.0, 0.1, 0.5, 1.0))
    assert ranking.numbered(df.limit(0), "g", ["v"]).count() == 0


def test_small_sinks_and_scans(spark, tmp_path):
    files.write_report({"b": 1, "a": [None, "é"]}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"a": [None, "é"], "b": 1}
    assert files.read_json(spark, str(tmp_path / "r.json"), "a array<string>, b int").first().b == 1
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    assert files.markdown_table(df).splitlines() == ["| k | v |", "|---|---|", "| 1 | a\\|b |", "| 2 |  |"]
    with pytest.raises(ValueError):
        files.markdown_table(df, 1)
    assert abs(spark.range(1).select(numeric.decibels(F.lit(0.1)).alias("x")).first().x + 20) < 1e-9
    assert spark.range(1).select(numeric.decibels(F.lit(0.0)).alias("x")).first().x == -240


# joins and lineage


def test_bounded_and_salted_joins(spark):
    large = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || id % 50 END AS k")
    small = spark.createDataFrame([("hot", 1), ("k7", 2)], "k string, v int")
    want = sorted(map(tuple, large.join(small, "k", "left").select("id", "v").collect()), key=str)
    for rows in (10, 1):  # broadcast, and salted
        assert sorted(map(tuple, tables.join_small(large, small, ["k"], "id", "left", rows).select("id", "v").collect()), key=str) == want
    side, fits = tables.bounded(small)
    assert fits and not tables.bounded(small, size=1)[1]
    tables.release(side)
    df = tables.cut(small)
    assert df.count() == 2
    tables.release(df)
    with pytest.raises(Exception, match="(?i)exist|not.*found"):
        df.count()


def test_flattened_tables_of_one_scan(spark):
    df = spark.createDataFrame([(1, '[{"a": {"b": [{"c": 1}]}}]')], "id bigint, j string")
    t = nested.flatten(df, "id", {"j": [nested.Ancestor("x", (nested.ITEMS,), ("a",), kinds=("a",)), nested.Ancestor("y", (nested.ITEMS, ("a",), ("b",), nested.ITEMS), ("c",), foreign=True)]})
    assert t["x"].first().leaf_a_kind == "map" and t["y"].first().steps == ["0", "0"] and t["y"].first().leaf_c == "1"
    assert vectors and signals  # imported for their names
