"""Queries of vector analytics and combination ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import combos, pools, quality, vectors
from tonelake.plans.ratings import SCALARS, rounded
from tonelake.sources.tables import table


EMBEDDING_WIDTH = 64
#: The imbalance is a quality check only and must not enter distances.
DISTANCE_SCALARS = [c for c in SCALARS if c != "stereo_imbalance"]


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return vectors.members(table(spark, d, "features"), "excerpt_id", "mix_id", "feature_row_id", SCALARS)


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as pools by label."""
    return table(spark, d, "embeddings").where("embedding is not null").select(F.col("label").cast("string").alias("grp"), F.col("vec_id").cast("string").alias("member"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("x"))


def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    scaled = vectors.robust_scale(_pool(spark, d))
    return rounded(scaled.select("grp", "member", F.posexplode("x").alias("dim", "scaled")))


def block_weight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.block_weight(_pool(spark, d)).select("grp", "member", F.posexplode("x").alias("dim", "weighted")))


def pairwise_euclidean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.edges(_embedded(spark, d), vectors.euclidean_of(EMBEDDING_WIDTH)))


def pairwise_manhattan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.edges(_pool(spark, d), vectors.manhattan))


def medoid_per_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.medoids(vectors.edges(_pool(spark, d), vectors.euclidean_of(len(SCALARS)))))


def nearest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.nearest(vectors.edges(_embedded(spark, d), vectors.euclidean_of(EMBEDDING_WIDTH))))


def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.near_duplicates(vectors.edges(_pool(spark, d), vectors.euclidean_of(len(SCALARS)))))


def outlier_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.outlier_scores(vectors.robust_scale(_pool(spark, d))))


def imbalance_qc(spark: SparkSession, d: str) -> DataFrame:
    pool = vectors.members(table(spark, d, "features"), "excerpt_id", "mix_id", "feature_row_id", SCALARS, ["stereo_imbalance"])
    return rounded(vectors.imbalance_qc(pool, "grp", "stereo_imbalance").select("grp", "member", "qc_score", "qc_flag", "qc_priority"))


def _triples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = vectors.edges(_pool(spark, d), vectors.euclidean_of(len(SCALARS)))
    return combos.triples(e), e


def best_triplet(spark: SparkSession, d: str) -> DataFrame:
    return rounded(combos.best_triples(_triples(spark, d)[0]).select("grp", "a", "b", "c", "min_d", "mean_d"))


def best_triplet_with_medoid(spark: SparkSession, d: str) -> DataFrame:
    t, e = _triples(spark, d)
    return rounded(combos.best_triples(t, vectors.medoids(e)).select("grp", "medoid", "a", "b", "c", "min_d", "mean_d"))


def exact_kmedoids3(spark: SparkSession, d: str) -> DataFrame:
    t, e = _triples(spark, d)
    pool = _pool(spark, d)
    whole = vectors.both_ways(e).unionByName(pool.select("grp", F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(0.0).alias("d")))
    return rounded(combos.medoid_triples(t, whole).select("grp", "a", "b", "c", "inertia"))


def _objectives(spark: SparkSession, d: str) -> DataFrame:
    """Triples of the rated mixes of each pool, scored by the mixes' mean preference; under review from |imbalance| 4, with caution below five ratings."""
    t, _ = _triples(spark, d)
    rated = table(spark, d, "evaluations").where("preference_score_0_1 between 0 and 1").groupBy(F.col("mix_id").alias("member")).agg(F.round(F.avg("preference_score_0_1"), 9).alias("score"), F.count(F.lit(1)).alias("ratings"))
    pool = vectors.members(table(spark, d, "features"), "excerpt_id", "mix_id", "feature_row_id", SCALARS, ["stereo_imbalance"])
    scores = pool.join(rated, "member").select("grp", "idx", F.col("member").alias("name"), "score", combos.quality_status(F.abs("stereo_imbalance") >= 4, F.col("ratings") < 5).alias("status"))
    return combos.ranked(combos.triple_objective(t, combos.with_tertiles(scores)))


def triplet_objective_top10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_objectives(spark, d).where("rank <= 10").select("grp", "condition", "rank", "number", "names", "spread", "objective"))


def wide_min_overlap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(combos.least_overlap(_objectives(spark, d)).select("grp", "rank", "overlap", "names", "objective"))


def six_from_triplets(spark: SparkSession, d: str) -> DataFrame:
    """The best similar triple of each pool with the wide triple that shares least with it: its set of up to six mixes."""
    return combos.six_members(_objectives(spark, d)).select("grp", F.array_join("members", "|").alias("members"), "shared")


def _five_of_six(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "selection_method_comparison").select("selection_id", "excerpt_id", F.array_distinct(F.transform(F.split("mix_ids", r"\|"), lambda x: F.trim(x))).alias("mixes")).where(F.size("mixes") == 6)
    long = combos.subsets_of_one_less(sets, "selection_id", "mixes")
    pool = _pool(spark, d)
    e = vectors.edges(pool, vectors.euclidean_of(len(SCALARS)))
    name = lambda c, n: pool.select("grp", F.col("idx").alias(c), F.col("member").alias(n))
    named = e.join(name("i", "m"), ["grp", "i"]).join(name("j", "n"), ["grp", "j"]).select(F.col("grp").alias("excerpt_id"), "m", "n", "d")
    pairs = sets.select("selection_id", "excerpt_id", F.explode("mixes").alias("m"), "mixes").select("*", F.explode("mixes").alias("n")).drop("mixes").where("m < n").join(named, ["excerpt_id", "m", "n"]).select("selection_id", "m", "n", "d")
    rated = table(spark, d, "evaluations").where("preference_score_0_1 between 0 and 1").groupBy(F.col("mix_id").alias("member")).agg(F.round(F.avg("preference_score_0_1"), 9).alias("rating"))
    return combos.subset_scores(long, "selection_id", pairs, rated, 1.0)


def five_of_six(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_five_of_six(spark, d).select("selection_id", "left_out", "min_d", "median_d", "near_pairs", "rating_range", "similarity", "score", "rank"))


def replacement_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The best five of each set of six, ranked with the alignment record of its song."""
    songs = table(spark, d, "selection_method_comparison").select("selection_id", "song_id")
    aligned = table(spark, d, "six_mix_proposals").where("song_id is not null").groupBy("song_id").agg(combos.status_reliability("alignment_status").alias("reliability"))
    best = _five_of_six(spark, d).where("rank = 1").join(songs, "selection_id").join(aligned, "song_id", "left")
    got = combos.replacement_scores(best, F.coalesce("reliability", F.lit(0.0)))
    return rounded(got.select("selection_id", "song_id", "left_out", "reliability", "replacement"))


def _spaces(spark: SparkSession, d: str) -> DataFrame:
    """Pools with the scalars that may enter distances and their spectra."""
    pools.forbid(DISTANCE_SCALARS, "stereo_imbalance")
    f = table(spark, d, "features").where("size(bark) = 48 and not exists(bark, v -> v is null or isnan(v))")
    return pools.with_vectors(vectors.members(f, "excerpt_id", "mix_id", "feature_row_id", DISTANCE_SCALARS, ["bark", F.col("institution_code").alias("institution")]))


def combined_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pools.combined_edges(_spaces(spark, d)))


def combined_outliers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pools.outliers(_spaces(spark, d)))


def pool_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return pools.quality_flags(_spaces(spark, d), DISTANCE_SCALARS)


def candidate_pools(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pools.pools(_spaces(spark, d), 10))


def pool_methods(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pools.pool_methods(_spaces(spark, d), 6))


def constrained_triplet(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pools.best_subset(_spaces(spark, d)))


def pool_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs by the pool's own distances, or listed because their rounded spectra are equal."""
    pool = _pool(spark, d)
    e = vectors.edges(pool, vectors.euclidean_of(len(SCALARS)))
    listed = quality.repeated_vectors(table(spark, d, "features").where("bark is not null and mix_id is not null"), "excerpt_id", "mix_id", "bark", 4)
    name = lambda c, n: pool.select("grp", F.col("idx").alias(c), F.col("member").alias(n))
    pairs = listed.select(F.col("excerpt_id").alias("grp"), F.least("mix_id", "previous").alias("m"), F.greatest("mix_id", "previous").alias("n")).where("m < n").distinct().join(name("i", "m"), ["grp", "m"]).join(name("j", "n"), ["grp", "n"])
    return rounded(vectors.near_duplicates(e, listed=pairs.select("grp", "i", "j")).select("grp", "i", "j", "d", "listed"))


def farthest_point3(spark: SparkSession, d: str) -> DataFrame:
    return vectors.farthest_pool(_pool(spark, d), 3)


def farthest_point_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    return vectors.farthest_pool(pool, 10, vectors.near_duplicates(vectors.edges(pool, vectors.euclidean_of(len(SCALARS)))))


def greedy_kmedoids(spark: SparkSession, d: str) -> DataFrame:
    return vectors.greedy_medoids(_pool(spark, d), 4)


def group_pca_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.explained_variance(table(spark, d, "features"), "song_id", "bark"))


QUERIES = {f.__name__: f for f in (
    robust_scale, block_weight, pairwise_euclidean, pairwise_manhattan, medoid_per_group, nearest_neighbour, near_duplicate_pairs, outlier_score, imbalance_qc, best_triplet, best_triplet_with_medoid, exact_kmedoids3,
    triplet_objective_top10, wide_min_overlap, five_of_six, farthest_point3, farthest_point_pool, greedy_kmedoids, group_pca_ratio,
    six_from_triplets, replacement_ranking, combined_edges, combined_outliers, pool_quality_flags, candidate_pools, pool_methods, constrained_triplet, pool_near_duplicates)}

_WHOLE = " AND ".join(f"isfinite({c})" for c in SCALARS)
_POOL = f"""one AS (SELECT * FROM features WHERE {_WHOLE} AND excerpt_id IS NOT NULL AND mix_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY excerpt_id, mix_id ORDER BY feature_row_id) = 1),
pool AS (SELECT excerpt_id AS grp, mix_id AS member, (row_number() OVER (PARTITION BY excerpt_id ORDER BY mix_id))::INTEGER AS idx, [{', '.join(SCALARS)}] AS x, stereo_imbalance FROM one)"""
_EMBEDDED = "pool AS (SELECT label::VARCHAR AS grp, vec_id AS idx, embedding::DOUBLE[] AS x FROM embeddings)"
_D = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_M = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2])))"
_r = lambda e, n: f"round({e} + 1e-10, 6) + 0.0 AS {n}"


def _edges(metric: str = _D) -> str:
    return f"edges AS (SELECT a.grp, a.idx AS i, b.idx AS j, {metric} AS d FROM pool a JOIN pool b ON a.grp = b.grp AND a.idx < b.idx), ways AS (SELECT * FROM edges UNION ALL SELECT grp, j, i, d FROM edges)"


_MEDOID = "totals AS (SELECT grp, i, round(sum(d), 9) AS total FROM ways GROUP BY 1, 2), medoid AS (SELECT grp, i AS medoid, total FROM totals QUALIFY row_number() OVER (PARTITION BY grp ORDER BY total, i) = 1)"
_TRIPLES = """triples AS (SELECT ab.grp, ab.i AS a, ab.j AS b, ac.j AS c, least(ab.d, ac.d, bc.d) AS min_d, (ab.d + ac.d + bc.d) / 3 AS mean_d FROM edges ab
  JOIN edges ac ON ab.grp = ac.grp AND ab.i = ac.i AND ab.j < ac.j JOIN edges bc ON bc.grp = ab.grp AND bc.i = ab.j AND bc.j = ac.j)"""
_ORDER = "round(min_d, 9) DESC, round(mean_d, 9) DESC, a, b, c"
_SCALED = """long AS (SELECT grp, member, idx, unnest(range(len(x)))::INTEGER AS dim, unnest(x) AS v FROM pool),
params AS (SELECT grp, dim, median(v) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM long GROUP BY 1, 2),
scaled AS (SELECT grp, member, idx, dim, CASE WHEN iqr > 1e-10 THEN (v - med) / iqr ELSE 0 END AS v FROM long JOIN params USING (grp, dim))"""
_OBJECTIVE = f"""rated AS (SELECT mix_id AS member, round(avg(preference_score_0_1), 9) AS score, count(*) AS ratings FROM evaluations WHERE preference_score_0_1 BETWEEN 0 AND 1 GROUP BY 1),
sc0 AS (SELECT grp, idx, member, score, CASE WHEN abs(stereo_imbalance) >= 4 THEN 0.05 WHEN ratings < 5 THEN 0.025 ELSE 0 END AS f FROM pool JOIN rated USING (member)),
tert AS (SELECT grp, quantile_cont(score, 1.0::DOUBLE / 3) AS t1, quantile_cont(score, 2.0::DOUBLE / 3) AS t2 FROM sc0 GROUP BY 1),
sc AS (SELECT sc0.*, CASE WHEN score <= t1 + 1e-9 THEN 0 WHEN score >= t2 - 1e-9 THEN 2 ELSE 1 END AS t FROM sc0 JOIN tert USING (grp)),
o1 AS (SELECT t.*, x.member || '|' || y.member || '|' || z.member AS names, greatest(x.score, y.score, z.score) - least(x.score, y.score, z.score) AS spread, x.t <> y.t AND x.t <> z.t AND y.t <> z.t AS varied, x.f + y.f + z.f AS flags,
  (row_number() OVER (PARTITION BY t.grp ORDER BY a, b, c))::INTEGER AS number FROM triples t
  JOIN sc x ON x.grp = t.grp AND x.idx = t.a JOIN sc y ON y.grp = t.grp AND y.idx = t.b JOIN sc z ON z.grp = t.grp AND z.idx = t.c),
o2 AS (SELECT *, {', '.join(f"CASE WHEN max({c}) OVER g - min({c}) OVER g > 1e-12 THEN ({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g) ELSE 0 END AS {n}" for c, n in (('min_d', 'near'), ('mean_d', 'far'), ('spread', 'wide')))} FROM o1 WINDOW g AS (PARTITION BY grp)),
o3 AS (SELECT *, 'wide' AS condition, 0.8 * (0.7 * near + 0.3 * far) - flags + 0.2 * wide + CASE WHEN varied THEN 0.03 ELSE 0 END AS objective FROM o2
  UNION ALL SELECT *, 'similar', 0.8 * (0.7 * near + 0.3 * far) - flags + 0.2 * (1 - wide) FROM o2),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY grp, condition ORDER BY round(objective, 9) DESC, round(min_d, 9) DESC, round(mean_d, 9) DESC, names DESC))::INTEGER AS rank FROM o3)"""
_LEAST_OVERLAP = """best AS (SELECT grp, names AS other FROM ranked WHERE condition = 'similar' AND rank = 1),
      w AS (SELECT r.*, other, len(list_intersect(string_split(names, '|'), string_split(other, '|')))::INTEGER AS overlap FROM ranked r JOIN best USING (grp) WHERE condition = 'wide'),
      k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY overlap, round(objective, 9) DESC, round(min_d, 9) DESC, names) AS rn FROM w)"""
_FIVE = f"""{_POOL}, {_edges()}, named AS (SELECT e.grp, p.member AS m, q.member AS n, d FROM edges e JOIN pool p ON p.grp = e.grp AND p.idx = i JOIN pool q ON q.grp = e.grp AND q.idx = j),
      s AS (SELECT selection_id, excerpt_id, list_distinct(list_transform(string_split(mix_ids, '|'), lambda x: trim(x))) AS mixes FROM selection_method_comparison),
      o AS (SELECT selection_id, excerpt_id, mixes, unnest(mixes) AS left_out FROM s WHERE len(mixes) = 6), l AS (SELECT selection_id, excerpt_id, left_out, member FROM (SELECT *, unnest(mixes) AS member FROM o) WHERE member <> left_out),
      d AS (SELECT a.selection_id, a.left_out, min(d) AS min_d, median(d) AS median_d, count(*) FILTER (WHERE d <= 1) AS near_pairs FROM l a JOIN l b ON a.selection_id = b.selection_id AND a.left_out = b.left_out AND a.member < b.member
            JOIN named n ON n.grp = a.excerpt_id AND n.m = a.member AND n.n = b.member GROUP BY 1, 2),
      rated AS (SELECT mix_id AS member, round(avg(preference_score_0_1), 9) AS rating FROM evaluations WHERE preference_score_0_1 BETWEEN 0 AND 1 GROUP BY 1),
      g AS (SELECT selection_id, left_out, rating, rating - lag(rating) OVER w AS gap, rating - lag(rating, 2) OVER w AS span3 FROM l JOIN rated USING (member) WINDOW w AS (PARTITION BY selection_id, left_out ORDER BY rating)),
      r AS (SELECT selection_id, left_out, max(rating) - min(rating) AS rating_range, min(gap) AS pair, min(span3) AS triple FROM g GROUP BY 1, 2),
      j AS (SELECT d.*, coalesce(rating_range, 0) AS rating_range, CASE WHEN triple <= 0.08 THEN 1 ELSE greatest(0, 1 - coalesce(pair, 1) / 0.18) END AS similarity FROM d LEFT JOIN r USING (selection_id, left_out)),
      n AS (SELECT *, {', '.join(f"CASE WHEN max({c}) OVER w - min({c}) OVER w > 1e-12 THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0.5 END AS n{k}" for k, c in enumerate(('min_d', 'median_d', 'rating_range')))} FROM j WINDOW w AS (PARTITION BY selection_id)),
      sco AS (SELECT *, 0.38 * n0 + 0.25 * n1 + 0.22 * n2 + 0.15 * similarity - 0.5 * near_pairs AS score FROM n),
      fin AS (SELECT *, (row_number() OVER (PARTITION BY selection_id ORDER BY round(score, 9) DESC, round(min_d, 9) DESC, round(median_d, 9) DESC, left_out))::INTEGER AS rank FROM sco)"""

SQL = {
    "robust_scale": f"WITH {_POOL}, {_SCALED} SELECT grp, member, dim, {_r('v', 'scaled')} FROM scaled",
    "block_weight": f"""WITH {_POOL}, n AS (SELECT *, list_sum(list_transform(x, lambda v: v * v)) AS n2 FROM pool), w AS (SELECT *, sqrt(avg(n2) OVER (PARTITION BY grp)) AS w FROM n),
      u AS (SELECT grp, member, w, unnest(range(len(x)))::INTEGER AS dim, unnest(x) AS v FROM w) SELECT grp, member, dim, {_r('CASE WHEN w > 1e-12 THEN v / w ELSE 0 END', 'weighted')} FROM u""",
    "pairwise_euclidean": f"WITH {_EMBEDDED}, {_edges()} SELECT grp, i, j, {_r('d', 'd')} FROM edges",
    "pairwise_manhattan": f"WITH {_POOL}, {_edges(_M)} SELECT grp, i, j, {_r('d', 'd')} FROM edges",
    "medoid_per_group": f"WITH {_POOL}, {_edges()}, {_MEDOID} SELECT grp, medoid, {_r('total', 'total')} FROM medoid",
    "nearest_neighbour": f"WITH {_EMBEDDED}, {_edges()} SELECT grp, i, j AS neighbour, {_r('d', 'd')} FROM ways QUALIFY row_number() OVER (PARTITION BY grp, i ORDER BY d, j) = 1",
    "near_duplicate_pairs": f"""WITH {_POOL}, {_edges()}, l AS (SELECT grp, greatest(coalesce(quantile_cont(d, 0.02) FILTER (WHERE d > 0), 0), 1e-9) AS lim FROM edges GROUP BY 1)
      SELECT grp, i, j, {_r('d', 'd')}, {_r('lim', '"limit"')} FROM edges JOIN l USING (grp) WHERE d <= lim""",
    "outlier_score": f"""WITH {_POOL}, {_SCALED}, spool AS (SELECT grp, member, idx, list(v ORDER BY dim) AS x FROM scaled GROUP BY 1, 2, 3),
      {_edges().replace('pool', 'spool')}, {_MEDOID},
      mid AS (SELECT grp, dim, median(v) AS m FROM scaled GROUP BY 1, 2),
      c AS (SELECT s.grp, s.member, s.idx, max(abs(s.v)) AS largest, sqrt(sum((s.v - m.m) ** 2)) AS c FROM scaled s JOIN mid m USING (grp, dim) GROUP BY 1, 2, 3),
      z AS (SELECT c.*, coalesce(w.d, 0) AS m FROM c JOIN medoid k ON k.grp = c.grp LEFT JOIN ways w ON w.grp = c.grp AND w.i = c.idx AND w.j = k.medoid),
      y AS (SELECT *, c / coalesce(median(CASE WHEN c > 0 THEN c END) OVER g, 1) AS fc, m / coalesce(median(CASE WHEN m > 0 THEN m END) OVER g, 1) AS fm FROM z WINDOW g AS (PARTITION BY grp))
      SELECT grp, member, {_r('largest', 'largest')}, {_r('fc', 'from_centre')}, {_r('fm', 'from_medoid')}, {_r('largest + fc + fm', 'score')} FROM y""",
    "imbalance_qc": f"""WITH {_POOL}, a AS (SELECT *, abs(stereo_imbalance) AS a FROM pool), b AS (SELECT *, median(a) OVER g AS m, quantile_cont(a, 0.75) OVER g - quantile_cont(a, 0.25) OVER g AS iqr FROM a WINDOW g AS (PARTITION BY grp)),
      c AS (SELECT *, (a - m) / greatest(1.4826 * median(abs(a - m)) OVER (PARTITION BY grp), iqr / 1.349, 0.02) AS s FROM b)
      SELECT grp, member, {_r('s', 'qc_score')}, s >= 3.5 AS qc_flag, CASE WHEN s >= 5 THEN 'high' WHEN s >= 3.5 THEN 'review' ELSE 'none' END AS qc_priority FROM c""",
    "best_triplet": f"WITH {_POOL}, {_edges()}, {_TRIPLES}, t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_ORDER}) AS rn FROM triples) SELECT grp, a, b, c, {_r('min_d', 'min_d')}, {_r('mean_d', 'mean_d')} FROM t WHERE rn = 1",
    "best_triplet_with_medoid": f"WITH {_POOL}, {_edges()}, {_MEDOID}, {_TRIPLES}, t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_ORDER}) AS rn FROM triples JOIN medoid USING (grp) WHERE medoid IN (a, b, c)) SELECT grp, medoid, a, b, c, {_r('min_d', 'min_d')}, {_r('mean_d', 'mean_d')} FROM t WHERE rn = 1",
    "exact_kmedoids3": f"""WITH {_POOL}, {_edges()}, {_TRIPLES}, alld AS (SELECT * FROM ways UNION ALL SELECT grp, idx, idx, 0 FROM pool),
      inertia AS (SELECT t.grp, a, b, c, mean_d, round(sum(least(x.d, y.d, z.d)), 9) AS inertia FROM triples t JOIN alld x ON x.grp = t.grp AND x.i = a JOIN alld y ON y.grp = t.grp AND y.i = b AND y.j = x.j JOIN alld z ON z.grp = t.grp AND z.i = c AND z.j = x.j GROUP BY 1, 2, 3, 4, 5),
      r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY inertia, round(mean_d, 9) DESC, a, b, c) AS rn FROM inertia) SELECT grp, a, b, c, {_r('inertia', 'inertia')} FROM r WHERE rn = 1""",
    "triplet_objective_top10": f"WITH {_POOL}, {_edges()}, {_TRIPLES}, {_OBJECTIVE} SELECT grp, condition, rank, number, names, {_r('spread', 'spread')}, {_r('objective', 'objective')} FROM ranked WHERE rank <= 10",
    "wide_min_overlap": f"WITH {_POOL}, {_edges()}, {_TRIPLES}, {_OBJECTIVE}, {_LEAST_OVERLAP} SELECT grp, rank, overlap, names, {_r('objective', 'objective')} FROM k WHERE rn = 1",
    "six_from_triplets": f"WITH {_POOL}, {_edges()}, {_TRIPLES}, {_OBJECTIVE}, {_LEAST_OVERLAP} SELECT grp, array_to_string(list_sort(list_distinct(list_concat(string_split(names, '|'), string_split(other, '|')))), '|') AS members, overlap AS shared FROM k WHERE rn = 1",
    "five_of_six": f"WITH {_FIVE} SELECT selection_id, left_out, {_r('min_d', 'min_d')}, {_r('median_d', 'median_d')}, near_pairs, {_r('rating_range', 'rating_range')}, {_r('similarity', 'similarity')}, {_r('score', 'score')}, rank FROM fin",
    "replacement_ranking": f"""WITH {_FIVE}, al AS (SELECT song_id, (count(*) FILTER (WHERE alignment_status = 'PASS') + 0.65 * count(*) FILTER (WHERE alignment_status = 'REVIEW')) / count(*) AS reliability FROM six_mix_proposals WHERE song_id IS NOT NULL GROUP BY 1)
      SELECT selection_id, c.song_id, left_out, {_r('reliability', 'reliability')}, {_r('0.35 * min_d + 0.20 * median_d + 1.2 * rating_range + 0.75 * coalesce(reliability, 0)', 'replacement')}
      FROM fin JOIN selection_method_comparison c USING (selection_id) LEFT JOIN al ON al.song_id = c.song_id WHERE rank = 1""",
    "pool_near_duplicates": f"""WITH {_POOL}, {_edges()}, l AS (SELECT grp, greatest(coalesce(quantile_cont(d, 0.02) FILTER (WHERE d > 0), 0), 1e-9) AS lim FROM edges GROUP BY 1),
      v AS (SELECT DISTINCT excerpt_id AS grp, mix_id, list_transform(bark, lambda x: round(x, 4)) AS h FROM features WHERE bark IS NOT NULL AND mix_id IS NOT NULL),
      o AS (SELECT *, lag(mix_id) OVER (PARTITION BY grp, h ORDER BY mix_id) AS prev FROM v), pr AS (SELECT DISTINCT grp, least(mix_id, prev) AS m, greatest(mix_id, prev) AS n FROM o WHERE prev IS NOT NULL AND prev <> mix_id),
      li AS (SELECT pr.grp, p.idx AS i, q.idx AS j FROM pr JOIN pool p ON p.grp = pr.grp AND p.member = m JOIN pool q ON q.grp = pr.grp AND q.member = n)
      SELECT e.grp, e.i, e.j, {_r('e.d', 'd')}, li.i IS NOT NULL AS listed FROM edges e JOIN l USING (grp) LEFT JOIN li ON li.grp = e.grp AND li.i = e.i AND li.j = e.j WHERE e.d <= lim OR li.i IS NOT NULL""",
    "farthest_point3": f"""WITH {_POOL}, {_edges()}, {_MEDOID}, alld AS (SELECT * FROM ways),
      s1 AS (SELECT grp, medoid AS k FROM medoid),
      s2 AS (SELECT a.grp, a.i AS k FROM alld a JOIN s1 ON s1.grp = a.grp AND a.j = s1.k QUALIFY row_number() OVER (PARTITION BY a.grp ORDER BY round(a.d, 9) DESC, a.i) = 1),
      c3 AS (SELECT a.grp, a.i, least(a.d, b.d) AS lo, (a.d + b.d) / 2 AS mean FROM alld a JOIN s1 ON s1.grp = a.grp AND a.j = s1.k JOIN s2 ON s2.grp = a.grp JOIN alld b ON b.grp = a.grp AND b.i = a.i AND b.j = s2.k WHERE a.i <> s2.k),
      s3 AS (SELECT grp, i AS k FROM c3 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(lo, 9) DESC, round(mean, 9) DESC, i) = 1),
      s AS (SELECT *, 1 AS position FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3) SELECT s.grp, member, position FROM s JOIN pool p ON p.grp = s.grp AND p.idx = s.k""",
}
