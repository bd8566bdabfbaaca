"""Queries of the general data problems: orphan references, nested cells, rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import nested, orphans
from tonelake.sources import records
from tonelake.sources.tables import table

REF_FIELDS = ["song_id", "episode_id", "stimulus_id"]

RAW_COLUMNS = [
    "study_id", "trial_index", "episode_id", "song_id", "display_label", "display_position", "actual_mix_id", "stimulus_id",
    "rating", "rating_set", "audio_played", "response_time_ms", "completed_at", "comparative_comment",
]
RAW_CHECKS = {"rating": records.rating_ok, "display_label": records.label_ok}


def _parents(spark: SparkSession, d: str) -> list[orphans.Parent]:
    return [
        orphans.Parent("song_id", "songs", table(spark, d, "songs"), "song_id", "added_at", "removed_at"),
        orphans.Parent("episode_id", "episodes", table(spark, d, "episodes"), "episode_id", "opened_at", "closed_at"),
        orphans.Parent("stimulus_id", "stimuli", table(spark, d, "stimuli"), "stimulus_id", "registered_at", "withdrawn_at"),
    ]


def _references(spark: SparkSession, d: str) -> DataFrame:
    return orphans.references(table(spark, d, "responses_long"), "response_row_id", REF_FIELDS, ["completed_at", "received_at"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(_references(spark, d), _parents(spark, d)).select(F.col("row_id").alias("response_row_id"), "ref_field")


def p1_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_references(spark, d), _parents(spark, d))


_CELLS = {
    "responses_json": [nested.Ancestor("responses", nested.RESPONSES.steps, ("stimulus_id",))],
    "trial_records_json": [nested.Ancestor("versions", nested.VERSIONS.steps, ("stimulus_id",))],
    "mix_mapping_json": [nested.Ancestor("mapping", nested.MAPPING.steps, ("stimulus_id",), scalar="stimulus_id")],
}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    leaves = nested.shred(table(spark, d, "submissions"), "submission_row_id", _CELLS)
    return leaves.select(F.col("row_id").alias("submission_row_id"), "source_field", "path", F.coalesce("leaf_stimulus_id", F.lit("")).alias("stimulus_id"))


def _p4_table(name: str, column: str, ancestor: nested.Ancestor):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = nested.shred(table(spark, d, "submissions"), "submission_row_id", {column: [ancestor]})
        return rows.select(F.col("row_id").alias("submission_row_id"), "path", "parent_path", *(F.col(f"leaf_{x}").alias(x) for x in ancestor.leaves), "other")

    query.__name__ = name
    return query


p4_responses = _p4_table("p4_responses", "responses_json", nested.RESPONSES)
p4_trials = _p4_table("p4_trials", "trial_records_json", nested.TRIALS)
p4_versions = _p4_table("p4_versions", "trial_records_json", nested.VERSIONS)
p4_devices = _p4_table("p4_devices", "trial_records_json", nested.DEVICES)
p4_device_levels = _p4_table("p4_device_levels", "trial_records_json", nested.LEVELS)
p4_play_events = _p4_table("p4_play_events", "trial_records_json", nested.PLAYS)
p4_mapping = _p4_table("p4_mapping", "mix_mapping_json", nested.MAPPING)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    raw = records.rejects(table(spark, d, "responses_raw"), "line_id", "line", RAW_COLUMNS, RAW_CHECKS).withColumn("source_table", F.lit("responses_raw"))
    long = records.rejected_values(table(spark, d, "responses_long"), "response_row_id", RAW_CHECKS).withColumn("source_table", F.lit("responses_long"))
    return raw.unionByName(long).select("source_table", "row_id", "reason")


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The conforming records of responses_raw, typed."""
    rows = records.load_strict(table(spark, d, "responses_raw"), "line_id", "line", RAW_COLUMNS, RAW_CHECKS)
    flag = lambda c: F.when(F.lower(records.strip_blanks(F.col(c))).isin("true", "1"), F.lit(True)).when(F.lower(records.strip_blanks(F.col(c))).isin("false", "0"), F.lit(False))
    number = lambda c, kind: records.strip_blanks(F.col(c)).try_cast(kind)
    return rows.select(
        F.col("row_id").alias("line_id"), "study_id", number("trial_index", "int").alias("trial_index"), "episode_id", "song_id",
        records.version_label(F.col("display_label")).alias("display_label"), number("display_position", "int").alias("display_position"),
        "actual_mix_id", "stimulus_id", number("rating", "int").alias("rating"), flag("rating_set").alias("rating_set"), flag("audio_played").alias("audio_played"),
        number("response_time_ms", "bigint").alias("response_time_ms"), number("completed_at", "timestamp_ntz").alias("completed_at"), "comparative_comment",
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_by_month, p4_found, p4_responses, p4_trials, p4_versions, p4_devices, p4_device_levels, p4_play_events, p4_mapping, p6_found, p6_loaded)}

_REFS = """
refs AS (
  SELECT response_row_id, ref_field, ref_key, at_time FROM (
    SELECT response_row_id, coalesce(completed_at, received_at) AS at_time,
           unnest(['song_id', 'episode_id', 'stimulus_id']) AS ref_field,
           unnest([lower(trim(song_id, ' ' || chr(9))), lower(trim(episode_id, ' ' || chr(9))), lower(trim(stimulus_id, ' ' || chr(9)))]) AS ref_key
    FROM responses_long) x
  WHERE ref_key <> ''),
parents AS (
  SELECT 'song_id' AS ref_field, lower(trim(song_id, ' ' || chr(9))) AS ref_key, added_at AS a, removed_at AS b FROM songs
  UNION ALL SELECT 'episode_id', lower(trim(episode_id, ' ' || chr(9))), opened_at, closed_at FROM episodes
  UNION ALL SELECT 'stimulus_id', lower(trim(stimulus_id, ' ' || chr(9))), registered_at, withdrawn_at FROM stimuli),
judged AS (
  SELECT r.*,
         NOT EXISTS (SELECT 1 FROM parents p WHERE p.ref_field = r.ref_field AND p.ref_key = r.ref_key) AS missing,
         NOT EXISTS (SELECT 1 FROM parents p WHERE p.ref_field = r.ref_field AND p.ref_key = r.ref_key
                     AND (r.at_time IS NULL OR ((p.a IS NULL OR p.a <= r.at_time) AND (p.b IS NULL OR r.at_time < p.b)))) AS orphan
  FROM refs r)
"""

_FIELD = '(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
_WELL_QUOTED = f"regexp_full_match(coalesce(line, ''), '{_FIELD}(?:,{_FIELD})*', 's')"
_RATING = "coalesce(regexp_full_match(trim({0}, ' ' || chr(9)), '[0-9]{{1,3}}') AND try_cast(trim({0}, ' ' || chr(9)) AS INTEGER) <= 100, false)"
_LABEL = "coalesce(regexp_full_match(regexp_replace(trim({0}, ' ' || chr(9)), '^(?i:version)[ \\t]+', ''), '[A-F]'), false)"

SQL = {
    "p1_found": f"WITH {_REFS} SELECT response_row_id, ref_field FROM judged WHERE orphan",
    "p1_by_month": f"""WITH {_REFS} SELECT CASE ref_field WHEN 'song_id' THEN 'songs' WHEN 'episode_id' THEN 'episodes' ELSE 'stimuli' END AS ref_table,
        coalesce(strftime(at_time, '%Y-%m'), 'unknown') AS period, count(*) AS refs, count(*) FILTER (WHERE orphan) AS orphans,
        count(*) FILTER (WHERE missing) AS without_parent FROM judged GROUP BY 1, 2""",
    # fields are cut at commas outside quotes: those are turned into chr(1) by blanking the quoted parts' commas first
    "p6_found": f"""
WITH good AS (SELECT line_id, coalesce(line, '') AS line, {_WELL_QUOTED} AS well FROM responses_raw),
counted AS (SELECT *, 1 + length(regexp_replace(line, '"[^"]*"', '', 'g')) - length(replace(regexp_replace(line, '"[^"]*"', '', 'g'), ',', '')) AS n FROM good),
cut AS (SELECT line_id, regexp_extract(line, '^(?:{_FIELD},){{4}}({_FIELD}),', 1, 's') AS label, regexp_extract(line, '^(?:{_FIELD},){{8}}({_FIELD}),', 1, 's') AS rating
        FROM counted WHERE well AND n = 14),
plain AS (SELECT line_id, CASE WHEN label LIKE '"%' THEN replace(label[2:-2], '""', '"') ELSE label END AS label,
                 CASE WHEN rating LIKE '"%' THEN replace(rating[2:-2], '""', '"') ELSE rating END AS rating FROM cut),
a AS (SELECT 'responses_raw' AS source_table, line_id AS row_id, label, rating FROM plain
      UNION ALL SELECT 'responses_long', response_row_id, display_label, rating FROM responses_long)
SELECT 'responses_raw' AS source_table, line_id AS row_id, CASE WHEN well THEN 'column_count' ELSE 'quoting' END AS reason FROM counted WHERE NOT well OR n <> 14
UNION ALL SELECT source_table, row_id, 'rating' FROM a WHERE NOT {_RATING.format('rating')}
UNION ALL SELECT source_table, row_id, 'display_label' FROM a WHERE NOT {_LABEL.format('label')}""",
    "p6_loaded": f"""
WITH good AS (SELECT line_id, line, {_WELL_QUOTED} AS well FROM (SELECT line_id, coalesce(line, '') AS line FROM responses_raw)),
counted AS (SELECT *, 1 + length(regexp_replace(line, '"[^"]*"', '', 'g')) - length(replace(regexp_replace(line, '"[^"]*"', '', 'g'), ',', '')) AS n FROM good),
cut AS (SELECT line_id, {', '.join(f"regexp_extract(line, '^(?:{_FIELD},){{{k}}}({_FIELD})(?:,|$)', 1, 's') AS r{k}" for k in range(14))} FROM counted WHERE well AND n = 14),
plain AS (SELECT line_id, {', '.join(f"CASE WHEN r{k} LIKE '{chr(34)}%' THEN replace(r{k}[2:-2], '{chr(34) * 2}', '{chr(34)}') ELSE r{k} END AS f{k}" for k in range(14))} FROM cut),
trimmed AS (SELECT *, {', '.join(f"trim(f{k}, ' ' || chr(9)) AS t{k}" for k in range(14))} FROM plain WHERE {_RATING.format('f8')} AND {_LABEL.format('f4')})
SELECT line_id, f0 AS study_id, TRY_CAST(t1 AS INTEGER) AS trial_index, f2 AS episode_id, f3 AS song_id, regexp_replace(t4, '^(?i:version)[ \t]+', '') AS display_label, TRY_CAST(t5 AS INTEGER) AS display_position, f6 AS actual_mix_id, f7 AS stimulus_id,
  TRY_CAST(t8 AS INTEGER) AS rating, CASE lower(t9) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN '0' THEN false END AS rating_set, CASE lower(t10) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN '0' THEN false END AS audio_played,
  TRY_CAST(t11 AS BIGINT) AS response_time_ms, TRY_CAST(t12 AS TIMESTAMP) AS completed_at, f13 AS comparative_comment FROM trimmed""",
    # DuckDB's own parser also takes trailing commas and NaN; such cells are told by what stands outside strings
    "p4_found": r"""
WITH cells AS (
  SELECT submission_row_id AS id, CASE WHEN json_valid(responses_json) AND NOT regexp_matches(regexp_replace(responses_json, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}]|(?i:nan|inf)|/') THEN responses_json::JSON END AS r,
         CASE WHEN json_valid(trial_records_json) AND NOT regexp_matches(regexp_replace(trial_records_json, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}]|(?i:nan|inf)|/') THEN trial_records_json::JSON END AS t,
         CASE WHEN json_valid(mix_mapping_json) AND NOT regexp_matches(regexp_replace(mix_mapping_json, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}]|(?i:nan|inf)|/') THEN mix_mapping_json::JSON END AS m FROM submissions),
r1 AS (SELECT id, r, unnest(range(json_array_length(r)::BIGINT)) AS i FROM cells WHERE json_type(r) = 'ARRAY'),
r2 AS (SELECT id, i, json_extract(r, '$[' || i || ']') AS o FROM r1),
t1 AS (SELECT id, t, unnest(range(json_array_length(t)::BIGINT)) AS i FROM cells WHERE json_type(t) = 'ARRAY'),
t2 AS (SELECT id, i, json_extract(t, '$[' || i || ']') AS o FROM t1),
t3 AS (SELECT id, i, json_extract(o, CASE WHEN list_contains(json_keys(o), 'version_records') THEN '$.version_records' ELSE '$.versions' END) AS v FROM t2 WHERE json_type(o) = 'OBJECT'),
t4 AS (SELECT id, i, v, unnest(range(json_array_length(v)::BIGINT)) AS k FROM t3 WHERE json_type(v) = 'ARRAY'),
t5 AS (SELECT id, i, k, json_extract(v, '$[' || k || ']') AS o FROM t4),
m1 AS (SELECT id, m, unnest(json_keys(m)) AS e FROM cells WHERE json_type(m) = 'OBJECT'),
m2 AS (SELECT id, e, json_extract(m, '$."' || e || '"') AS o FROM m1),
m3 AS (SELECT id, e, o, unnest(json_keys(o)) AS s FROM m2 WHERE json_type(o) = 'OBJECT'),
m4 AS (SELECT id, e, s, json_extract(o, '$."' || s || '"') AS o FROM m3),
m5 AS (SELECT id, e, s, o, unnest(json_keys(o)) AS l FROM m4 WHERE json_type(o) = 'OBJECT'),
m6 AS (SELECT id, e, s, l, json_extract(o, '$."' || l || '"') AS o FROM m5)
SELECT id AS submission_row_id, 'responses_json' AS source_field, i::VARCHAR AS path, coalesce(json_extract_string(o, '$.stimulus_id'), '') AS stimulus_id FROM r2 WHERE json_type(o) = 'OBJECT'
UNION ALL SELECT id, 'trial_records_json', i || '/' || k, coalesce(json_extract_string(o, '$.stimulus_id'), '') FROM t5 WHERE json_type(o) = 'OBJECT'
UNION ALL SELECT id, 'mix_mapping_json', e || '/' || s || '/' || l,
  coalesce(CASE WHEN json_type(o) = 'OBJECT' THEN json_extract_string(o, '$.stimulus_id') ELSE json_extract_string(o, '$') END, '')
FROM m6 WHERE json_type(o) IN ('OBJECT', 'VARCHAR', 'NULL')""",
}
