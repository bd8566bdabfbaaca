"""SQL counterparts of the training-data queries that SQL can express on whole tables."""

_SCALARS = "rms_left rms_right rms_mean crest_factor_left crest_factor_right crest_factor_mean stereo_width stereo_imbalance".split()
_WHOLE = " AND ".join(f"isfinite({c})" for c in _SCALARS)
_APART = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in _SCALARS) + ")"

_VALUES = """
vals AS (
  SELECT song_id, rating_condition, review_round, measure, value FROM (
    SELECT song_id, rating_condition, review_round, 'median_previous_preference' AS measure, median_previous_preference AS value FROM six_mix_proposals
    UNION ALL SELECT song_id, rating_condition, review_round, 'rating_percentile_within_song', rating_percentile_within_song FROM six_mix_proposals) x
  WHERE isfinite(value) AND value BETWEEN 0 AND 1)
"""

SQL = {
    "p2_found": """
WITH valid AS (SELECT * FROM evaluations WHERE preference_score_0_1 BETWEEN 0 AND 1 AND participant_id IS NOT NULL AND mix_id IS NOT NULL),
once AS (SELECT participant_id, mix_id, preference_score_0_1 AS s FROM valid QUALIFY evaluation_id IS NULL OR row_number() OVER (PARTITION BY evaluation_id ORDER BY received_at DESC NULLS LAST) = 1),
enough AS (SELECT participant_id FROM once GROUP BY 1 HAVING count(*) >= 40),
mix AS (SELECT mix_id, count(*) AS n, sum(s) AS t FROM once GROUP BY 1),
own AS (SELECT participant_id, mix_id, count(*) AS n, sum(s) AS t FROM once GROUP BY 1, 2),
y AS (SELECT o.participant_id, o.s, (m.t - w.t) / (m.n - w.n) AS y FROM once o JOIN mix m USING (mix_id) JOIN own w USING (participant_id, mix_id) WHERE m.n > w.n)
SELECT participant_id FROM y SEMI JOIN enough USING (participant_id) GROUP BY 1 HAVING CASE WHEN max(s) = min(s) THEN 0 ELSE corr(s, y) END < 0.4""",
    "p3_found": f"""
WITH pool AS (SELECT * FROM features WHERE {_WHOLE} QUALIFY row_number() OVER (PARTITION BY excerpt_id, mix_id ORDER BY feature_row_id) = 1),
picked AS (SELECT DISTINCT selection_id, excerpt_id, trim(unnest(string_split(mix_ids, '|')), ' ' || chr(9)) AS mix_id FROM selection_method_comparison),
held AS (SELECT p.selection_id, f.* FROM picked p JOIN pool f USING (excerpt_id, mix_id)),
twice AS (SELECT DISTINCT a.selection_id FROM held a JOIN held b ON a.selection_id = b.selection_id AND a.mix_id < b.mix_id WHERE {_APART} < 1),
lacking AS (SELECT DISTINCT s.selection_id FROM selection_method_comparison s JOIN pool a USING (excerpt_id)
            WHERE NOT EXISTS (SELECT 1 FROM held b WHERE b.selection_id = s.selection_id AND {_APART} < 1))
SELECT selection_id FROM twice SEMI JOIN lacking USING (selection_id)""",
    "p5_found": f"""
WITH {_VALUES}, ranked AS (
  SELECT review_round, measure, value, row_number() OVER (PARTITION BY review_round, measure ORDER BY value) AS r, count(*) OVER (PARTITION BY review_round, measure) AS n FROM vals)
SELECT DISTINCT review_round, measure FROM ranked
WHERE review_round IS NOT NULL AND ((measure = 'median_previous_preference' AND r = greatest(1, ceil(round(0.95 * n, 6))) AND value >= 0.80)
   OR (measure = 'rating_percentile_within_song' AND r = greatest(1, ceil(round(0.5 * n, 6))) AND value >= 0.60))""",
    "p5_percentiles": f"""
WITH {_VALUES}, ranked AS (
  SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY song_id, rating_condition, review_round, measure) AS n FROM vals
  WINDOW w AS (PARTITION BY song_id, rating_condition, review_round, measure ORDER BY value))
SELECT song_id, rating_condition, review_round, measure, p, n, value FROM ranked, (SELECT unnest([0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95]) AS p) ps
WHERE r = greatest(1, ceil(round(p * n, 6)))""",
}
