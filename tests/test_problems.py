"""Orphan references, record loading and nested cells against brute force and on awkward input."""

import datetime as dt
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.operators import nested, orphans
from tonelake.plans import problems
from tonelake.sources import records

T = dt.datetime


def _parents(spark, rows):
    df = spark.createDataFrame(rows, "id string, a timestamp_ntz, b timestamp_ntz, at string")
    return [orphans.Parent("ref", "things", df, "id", "a", "b")]


def test_orphans_by_period_and_spelling(spark):
    parents = _parents(spark, [("Alpha ", None, None, "x"), ("beta", T(2024, 1, 1), T(2024, 2, 1), "x"), ("beta", T(2024, 3, 1), None, "x"), ("beta", T(2024, 3, 1), None, "x"), (None, None, None, "x")])
    rows = [(1, "\talpha", T(2020, 1, 1), None), (2, "BETA", T(2024, 1, 31), None), (3, "beta", T(2024, 2, 1), None), (4, "beta", None, T(2024, 3, 1)), (5, "gamma", None, None), (6, "beta", None, None), (7, None, T(2024, 1, 1), None), (8, " \t", T(2024, 1, 1), None), (9, "beta", T(2023, 1, 1), T(2024, 1, 2)), (9, "beta", T(2023, 1, 1), None)]
    children = spark.createDataFrame(rows, "id bigint, ref string, done timestamp_ntz, got timestamp_ntz").withColumnRenamed("id", "row")
    refs = orphans.references(children.selectExpr("*", "1 AS ref_key", "2 AS at"), "row", ["ref"], ["done", "got"])
    for bound in (200_000, 0):  # broadcast, and the way beyond it
        assert sorted(r.row_id for r in orphans.orphans(refs, parents, bound).collect()) == [3, 5, 9, 9]
    report = {(r.ref_table, r.period): (r.refs, r.orphans, r.without_parent) for r in orphans.orphan_report(refs, parents).collect()}
    assert report[("things", "2024-02")] == (1, 1, 0) and report[("things", "unknown")] == (2, 1, 1)
    assert sum(r[0] for r in report.values()) == 8


def test_orphans_of_empty_tables(spark):
    none = _parents(spark, [])
    empty = spark.createDataFrame([], "row bigint, ref string, done timestamp_ntz")
    assert orphans.orphans(orphans.references(empty, "row", ["ref"], ["done"]), none).count() == 0
    one = spark.createDataFrame([(1, "x", None)], "row bigint, ref string, done timestamp_ntz")
    assert orphans.orphans(orphans.references(one, "row", ["ref"], ["done"]), none).count() == 1


def plain_split(line):
    """The fields of a record by the rules, character by character; None for wrong quoting."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, text = i + 1, ""
            while True:
                if i >= n:
                    return None
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < n and line[i] != ",":
                return None
        else:
            k = line.find(",", i)
            k = n if k < 0 else k
            text, i = line[i:k], k
            if '"' in text:
                return None
        fields.append(text)
        if i >= n:
            return fields
        i += 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet='a,"\n\u0001\u0002b é', max_size=14), min_size=60, max_size=120))
def test_records_split_like_brute_force(spark, lines):
    lines += ['""', '"a,b"', '"a""b",c', "", ",", '"', 'a"b', '"a"b', '"a" ,b', '"x\ny",z', '"",""', '""""', 'a,""b']
    df = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")
    from pyspark.sql import functions as F

    got = {r.id: (r.ok, r.fields) for r in df.select("id", records.quoting_ok(F.col("line")).alias("ok"), records.split_record(F.col("line")).alias("fields")).collect()}
    for i, line in enumerate(lines):
        want = plain_split(line)
        assert got[i][0] == (want is not None), line
        if want is not None:
            assert got[i][1] == want, line


def test_rejects_and_reasons(spark):
    ok = {"a": records.rating_ok, "b": records.label_ok}
    rows = [(1, "70, version  B"), (2, '"007","Version A"'), (3, "101,a"), (4, "5"), (5, '5,"B'), (6, None), (7, ""), (8, "1,2,3"), (9, " 100\t,F"), (10, "５,F"), (11, "7\n,F"), (11, "7\n,F")]
    raw = spark.createDataFrame(rows, "id bigint, line string").selectExpr("*", "'x' AS row_id", "'y' AS loaded_id")
    got = sorted((r.row_id, r.reason) for r in records.rejects(raw, "id", "line", ["a", "b"], ok).collect())
    assert got == [(3, "a"), (3, "b"), (4, "column_count"), (5, "quoting"), (6, "column_count"), (7, "column_count"), (8, "column_count"), (10, "a"), (11, "a"), (11, "a")]
    assert sorted(r.row_id for r in records.load_strict(raw, "id", "line", ["a", "b"], ok).collect()) == [1, 2, 9]
    values = spark.createDataFrame([(1, "5", "A"), (2, None, "A"), (3, " ", "versionA"), (4, "1e1", "Version"), (5, "100", "VERSION\tC")], "id bigint, a string, b string")
    assert sorted((r.row_id, r.reason) for r in records.rejected_values(values, "id", ok).collect()) == [(2, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "b")]
    assert records.rejects(raw.limit(0), "id", "line", ["a", "b"], ok).count() == 0


def test_long_record(spark):
    line = '"' + 'x""y,' * 100_000 + '",2'
    raw = spark.createDataFrame([(1, line)], "id bigint, line string")
    row = records.load_strict(raw, "id", "line", ["a", "b"], {}).first()
    assert len(row.a) == 400_000 and row.b == "2"


def test_strict_json():
    good = ['{"a":1}', " [1, 2.50e3]\n", '"x"', "null", '{"a":1,"a":2}', "1" * 5000, "[" * 200_000 + "]" * 200_000, '{"a":' * 100_000 + "0" + "}" * 100_000]
    bad = ["", None, "NaN", "[1,]", "{'a':1}", "[1] x", "﻿[]", "[Infinity]", "01", '"\t"', "[" * 100_000]
    bad += ['{"a"}', '{"a":1,}', "[1 2]", '{"a" 1}', '["\\x"]', "]", "[1}", '{1:2}', "tru", "[,1]", "{,}", '{"a":1 "b":2}', "- 1", "1.", "[1]]"]
    assert all(nested.scan(g, []) is not None for g in good) and not any(nested.scan(b, []) is not None for b in bad)


def test_instance_below_many_levels():
    ancestor = nested.Ancestor("z", (nested.ITEMS, ("deep",)), ("x",), branches=())
    deep = '{"k":' * 50_000 + "1" + "}" * 50_000
    rows = nested.scan('[{"deep": {"x": 1, "y": %s}}]' % deep, [ancestor])
    assert [(i, at, row["x"], row["y"] == deep) for i, at, row in rows] == [(0, ("0",), "1", True)]


def test_scanner_agrees_with_the_json_module():
    rng = random.Random(3)
    pieces = ["{", "}", "[", "]", ",", ":", '"a"', '"b\\n"', "1", "-0.5e3", "true", "null", " ", "NaN", '"', "01"]

    def strict(text):
        def refuse(name):
            raise ValueError(name)

        try:
            json.loads(text, parse_constant=refuse)
        except ValueError:
            return False
        return True

    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 9)))
        assert (nested.scan(text, []) is not None) == strict(text), text


def test_of_repeated_keys_the_last_value_holds():
    versions = nested.Ancestor("v", (nested.ITEMS, ("version_records", "versions"), nested.ITEMS), ("s",))
    got = nested.scan('[{"versions": [{"s": 1}], "version_records": [{"s": 2}], "version_records": [{"s": 3, "s": 4}]}, {"version_records": 5, "versions": [{"s": 6}]}]', [versions])
    assert got == [(0, ("0", "0"), {"s": "4"})]


def test_nested_levels_and_foreign_elements(spark):
    trial = [{"version_records": [{"stimulus_id": "s1"}, None, {"stimulus_id": None}, "x"]}, 5, {"versions": [{"x": 1}]}, {"version_records": None, "versions": [{"stimulus_id": "no"}]}, {"version_records": {}}]
    mapping = {"E": {"S": {"A": "s1", "B": {"stimulus_id": "s2"}, "C": None, "D": [], "F": 7, "G": {}}, "T": []}, "F": None}
    rows = [(1, json.dumps([{"stimulus_id": "r"}, None, {}, [1]]), json.dumps(trial), json.dumps(mapping)), (2, "{}", "not json", "[]"), (3, None, "", "null"), (1, "[{}]", None, None)]
    df = spark.createDataFrame(rows, "id bigint, r string, t string, m string").selectExpr("*", "0 AS row_id", "0 AS path")
    leaf = ("stimulus_id",)
    got = nested.shred(df, "id", {"r": [nested.Ancestor("r", nested.RESPONSES.steps, leaf)], "t": [nested.Ancestor("t", nested.VERSIONS.steps, leaf)], "m": [nested.Ancestor("m", nested.MAPPING.steps, leaf, "stimulus_id")]})
    assert sorted((r.row_id, r.source_field, r.path, r.leaf_stimulus_id or "") for r in got.collect()) == sorted([
        (1, "r", "0", "r"), (1, "r", "2", ""), (1, "r", "0", ""), (1, "t", "0/0", "s1"), (1, "t", "0/2", ""), (1, "t", "2/0", ""),
        (1, "m", "E/S/A", "s1"), (1, "m", "E/S/B", "s2"), (1, "m", "E/S/C", ""), (1, "m", "E/S/G", ""),
    ])
    assert nested.shred(df.limit(0), "id", {"r": [nested.RESPONSES]}).count() == 0


def test_children_link_to_parents(spark):
    doc = [{"trial_index": i, "versions": [{"stimulus_id": f"{i}{k}", "play_events": [{"at_ms": k}] * k} for k in range(3)]} for i in range(4)]
    df = spark.createDataFrame([(7, json.dumps(doc))], "id bigint, t string")
    tables = nested.flatten(df, "id", {"t": [nested.TRIALS, nested.VERSIONS, nested.PLAYS]})
    paths = {n: {(r.row_id, r.path) for r in t.collect()} for n, t in tables.items()}
    assert {len(p) for p in paths.values()} == {4, 12}
    assert all((r.row_id, r.parent_path) in paths["trials"] for r in tables["versions"].collect())
    assert all((r.row_id, r.parent_path) in paths["versions"] for r in tables["play_events"].collect())


def test_tables_keep_whole_records(spark, tmp_path):
    version = {"display_label": "A", "display_position": 1, "actual_mix_id": "m", "stimulus_id": "s", "audio_path": "a.wav", "rating": 7.50, "rating_set": True, "audio_played": False, "first_play_timestamp": None, "response_time_ms": 12}
    trial = {"trial_index": 0, "episode_position": 1, "song_position": 2, "scenario_id": "c", "episode_id": "e", "song_id": "g", "excerpt_id": "x", "comparative_comment": "so"}
    new = {"volume": {"db": [-3.10, "\ud800", None]}, "": "unnamed", "gone": None}
    trials = [
        {**trial, **new, "device": {"output": "speakers", "levels": [{"db": -19, "at": 1}], "brand": "b"}, "versions": [{**version, **new, "play_events": [{"at_ms": 3, "action": "play", "by": "key"}]}]},
        {"device": "none", "version_records": {"A": 1}, "versions": [version]},
    ]
    responses = [{**trial, **version, **new, "comment": "old"}]
    mapping = {"e": {"g": {"A": {"stimulus_id": "s", "revision": 2, "note": "n"}}}}
    df = spark.createDataFrame([(1, *(json.dumps(x) for x in (responses, trials, mapping)))], "submission_row_id bigint, responses_json string, trial_records_json string, mix_mapping_json string")
    df.write.parquet(str(tmp_path / "submissions.parquet"))

    def rows(query):
        return [{k: v for k, v in r.asDict().items() if v is not None} for r in problems.QUERIES[query](spark, str(tmp_path)).orderBy("path").collect()]

    def flat(record):
        return {k: str(v) if not isinstance(v, bool) else str(v).lower() for k, v in record.items() if v is not None}

    rest = {"volume": '{"db": [-3.1, "\\ud800", null]}', "": "unnamed", "gone": None}
    at = {"submission_row_id": 1, "path": "0", "parent_path": ""}
    assert rows("p4_responses") == [{**at, **flat(trial), **flat(version), "comment": "old", "other": rest}]
    assert rows("p4_trials") == [{**at, **flat(trial), "other": rest}, {**at, "path": "1", "other": {"device": "none", "version_records": '{"A": 1}', "versions": json.dumps([version])}}]
    assert rows("p4_versions") == [{**at, "path": "0/0", "parent_path": "0", **flat(version), "other": rest}]
    assert rows("p4_devices") == [{**at, "parent_path": "0", "output": "speakers", "other": {"brand": "b"}}]
    assert rows("p4_device_levels") == [{**at, "path": "0/0", "parent_path": "0", "db": "-19", "other": {"at": "1"}}]
    assert rows("p4_play_events") == [{**at, "path": "0/0/0", "parent_path": "0/0", "at_ms": "3", "action": "play", "other": {"by": "key"}}]
    assert rows("p4_mapping") == [{**at, "path": "e/g/A", "parent_path": "e/g", "stimulus_id": "s", "revision": "2", "other": {"note": "n"}}]


def test_deep_random_documents(spark):
    rng = random.Random(5)

    def value(depth):
        return rng.choice([None, 1, "x", True]) if depth > 4 else rng.choice([{rng.choice("ab"): value(depth + 1) for _ in range(2)}, [value(depth + 1) for _ in range(3)], "y", None])

    ancestor = nested.Ancestor("z", (nested.ITEMS, ("a", "b"), nested.ITEMS), ("a",))

    def brute(v):
        out = []
        for i, x in enumerate(v) if isinstance(v, list) else ():
            if isinstance(x, dict):
                k = next((k for k in ("a", "b") if k in x), None)
                for j, y in enumerate(x[k]) if k and isinstance(x[k], list) else ():
                    if isinstance(y, dict):
                        out.append((str(i), str(j)))
        return out

    for _ in range(300):
        v = [value(0) for _ in range(3)]
        assert [at for _, at, _ in nested.scan(json.dumps(v), [ancestor])] == brute(v)
