"""Queries of response validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import responses
from tonelake.plans.study import _RESPONSE_CELLS
from tonelake.sources.tables import table


def _submissions(spark: SparkSession, d: str) -> responses.Submissions:
    return responses.Submissions(table(spark, d, "submissions"))


def submission_issues(spark: SparkSession, d: str) -> DataFrame:
    """Every deviation of the submissions, one row each."""
    return _submissions(spark, d).issues().withColumnRenamed("row_id", "submission_row_id")


def submission_trials(spark: SparkSession, d: str) -> DataFrame:
    """One row per submitted trial, in order, with what does not agree."""
    t = _submissions(spark, d).trials()
    joined = lambda c: F.array_join(c, " | ").alias(c)
    return t.select(F.col("row_id").alias("submission_row_id"), "trial_index", "trial_position", "episode_id", "song_id", "displayed", joined("labels"), joined("stimuli"), joined("mixes"), joined("comments"), "notes", "status")


def submission_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the conversion and of every issue code."""
    s = _submissions(spark, d)
    completed = responses.is_completed(F.col("submission_status"), F.col("completed_at"), F.col("responses_json"))
    return responses.report(s, s.issues(), completed)


def long_format_issues(spark: SparkSession, d: str) -> DataFrame:
    """Deviations of the responses that came flat, whose orders and mappings cannot be checked."""
    return responses.long_issues(table(spark, d, "responses_long"), "response_row_id").select(F.col("row_id").alias("response_row_id"), "field", "code")


def numeric_rating_issues(spark: SparkSession, d: str) -> DataFrame:
    return responses.numeric_rating_issues(_submissions(spark, d).responses).withColumnRenamed("row_id", "submission_row_id")


def completed_submissions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "submissions")
    return s.select("submission_row_id", responses.is_completed(F.col("submission_status"), F.col("completed_at"), F.col("responses_json")).alias("completed"))


QUERIES = {f.__name__: f for f in (submission_issues, submission_trials, submission_report, long_format_issues, numeric_rating_issues, completed_submissions)}

_BLANK = "coalesce(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '') = ''"
_REQUIRED = ("song_id", "display_label", "stimulus_id", "rating", "comparative_comment")
_MISSING = "\n".join(f"UNION ALL SELECT response_row_id, '{c}', '{'missing_stimulus_id' if c == 'stimulus_id' else 'missing_response_field'}' FROM r WHERE coalesce({c}, '') = ''" for c in _REQUIRED)

SQL = {
    "numeric_rating_issues": f"WITH {_RESPONSE_CELLS} SELECT submission_row_id, (i + 1)::VARCHAR AS place, 'rating' AS field, 'rating_not_numeric' AS code FROM ob WHERE coalesce(json_type(json_extract(o, '$.rating')), '') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')",
    "completed_submissions": f"""SELECT submission_row_id, coalesce(lower(trim(submission_status)) IN ('completed', 'local_only_completed'), false) OR (completed_at IS NOT NULL AND NOT {_BLANK.format(c='responses_json')}) AS completed FROM submissions""",
    "long_format_issues": f"""WITH r AS (SELECT *, CASE WHEN {_BLANK.format(c='episode_id')} THEN CASE WHEN {_BLANK.format(c='scenario_id')} THEN '' ELSE scenario_id END ELSE episode_id END AS ep FROM responses_long),
k AS (SELECT response_row_id, row_number() OVER (PARTITION BY coalesce(study_id, ''), coalesce(trial_index::VARCHAR, ''), ep, coalesce(song_id, ''), coalesce(display_label, '') ORDER BY response_row_id) AS n FROM r)
SELECT response_row_id, 'episode_id' AS field, 'missing_response_field' AS code FROM r WHERE ep = ''
{_MISSING}
UNION ALL SELECT response_row_id, 'rating', 'rating_not_integer_0_100' FROM r WHERE NOT (regexp_full_match(coalesce(rating, ''), '-?[0-9]{{1,9}}') AND coalesce(TRY_CAST(rating AS INTEGER) BETWEEN 0 AND 100, false))
UNION ALL SELECT response_row_id, 'responses_json', 'duplicate_response_within_trial' FROM k WHERE n > 1
UNION ALL SELECT min(response_row_id), 'responses_json', 'raw_json_unavailable' FROM r GROUP BY coalesce(study_id, '')""",
}
