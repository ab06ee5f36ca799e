"""Profiles, pair statistics, clusters, networks and speaker search over the ``utterance_vectors`` table.

A conversation is the call an utterance's id begins with, its speaker stands behind; of an id given again the newest line
counts, and vectors that are null, short, not finite or all zero take no part. Durations are those of the turn with the
same id, where there is one; they stand in for the quality of a reference too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parolis.functions import vec
from parolis.operators import graph, links, profiles, scoring
from parolis.operators.turns import valid_turns, with_ordinals
from parolis.plans.turns import ORDINALS_SQL
from parolis.runtime import cut_lineage, table

K, NETWORK, COHORT_K, DIM, KIND = 3, 10, 20, 192, "operateur"
#: Repeated ids up to which they are broadcast; above, the same join is a shuffle.
BROADCAST_ROWS = 1_000_000


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``discussion, speaker, utt_id, v`` of the valid utterances, vectors as stored. Only ids that are given again are shuffled."""
    e = table(spark, sf_dir, "utterance_vectors").where("utt_id IS NOT NULL AND line_no IS NOT NULL").select("utt_id", "line_no", "v")
    again = cut_lineage(e.groupBy("utt_id").agg(F.count("*").alias("n")).where("n > 1").select("utt_id"))
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    newest = e.join(again, "utt_id", "left_semi").groupBy("utt_id").agg(F.max_by("v", "line_no").alias("v"))
    all_ids = e.join(again, "utt_id", "left_anti").select("utt_id", "v").unionByName(newest)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = all_ids.where((F.size("v") == DIM) & finite & F.exists("v", lambda x: x != 0))
    part = lambda n: F.regexp_extract("utt_id", "^(.*)_([^_]*)_([^_]*)$", n)
    return valid.select(part(1).alias("discussion"), part(2).alias("speaker"), "utt_id", "v")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir).withColumn("v", vec.as_double(F.col("v")))
    t = with_ordinals(valid_turns(table(spark, sf_dir, "turns"))).select("utt_id", "duration")
    return x.join(t, "utt_id", "left").select("discussion", "speaker", "utt_id", "v", "duration")


def reference_id(s: DataFrame) -> str:
    """The enrolled utterance of the searches: the smallest id."""
    return s.agg(F.min("utt_id")).first()[0] or ""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


STATS = ("mean_sim", "min_sim", "max_sim", "std_sim")


def _nearest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, their top-k by centroid, the profiles."""
    s = segments(spark, sf_dir).drop("duration")
    top = profiles.top_by_centroid(s, K)
    return s, top, profiles.profiles(s, top)


def _longest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = segments(spark, sf_dir).where("duration IS NOT NULL")
    top = profiles.top_by_duration(s, K)
    return s, top, profiles.profiles(s, top)


def profile_topk_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.intra(*_nearest(spark, sf_dir)), *STATS)


def profile_topk_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.all_pairs(_nearest(spark, sf_dir)[2]), "sim")


def profile_longest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.intra(*_longest(spark, sf_dir)), *STATS, "profile_seconds")


def profile_longest_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.all_pairs(_longest(spark, sf_dir)[2]), "sim")


def pairs_intra_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = profiles.inner_statistics(vectors(spark, sf_dir)).drop("target")
    return _rounded(x.withColumnRenamed("ref", "discussion"), *STATS)


def pairs_inter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.outer_statistics(vectors(spark, sf_dir), decimals=6)


def mean_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of all pairs between two conversations, without forming the pairs."""
    means = profiles.unit_means(segments(spark, sf_dir))
    return profiles.all_pairs(means, unit=False).select("ref", "target", r6("sim").alias("mean_sim"))


def profile_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.split_half(segments(spark, sf_dir)), "split_half", "segment_vs_profile")


def split_half_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.split_half(segments(spark, sf_dir), weighted=False), "split_half", "segment_vs_profile")


def weighted_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.all_pairs(profiles.weighted_profiles(segments(spark, sf_dir))), "sim")


def _thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the mean similarity of their other segments, where they have two segments at least."""
    x = profiles.nearest_own(vectors(spark, sf_dir), K)
    w = F.when(F.col("n_segments") >= 2, r6("mean_sim")).otherwise(F.lit(float("nan")))
    return x.select(F.col("discussion").alias("key"), F.col("profile").alias("v"), w.alias("w"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.clusters(_thresholds(spark, sf_dir))


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.nearest_profiles(_nearest(spark, sf_dir)[2], NETWORK, 6)


def topn_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_reciprocal(_network(spark, sf_dir)).select("ref", "target", "rank", F.col("sim").alias("score"), "reciprocal")


def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = segments(spark, sf_dir).select(F.col("discussion").alias("node"))
    return graph.in_degree(_network(spark, sf_dir), nodes)


def reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.reciprocity(_thresholds(spark, sf_dir))


def triads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.levels(_thresholds(spark, sf_dir))


def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.level_counts(_thresholds(spark, sf_dir))


def cooccurrence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.sparse_matrix(_thresholds(spark, sf_dir))


def _score(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        corpus = vectors(spark, sf_dir).select("utt_id", "v")
        return _rounded(scoring.search(corpus, reference_id(corpus), method, COHORT_K, 0.1 if method == "cosine" else None), "score")

    return run


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    ref = s.where(F.col("utt_id") == reference_id(s)).select(vec.unit(F.col("v")).alias("rv"))
    x = s.withColumn("rv", ref.scalar()).withColumn("score", r6(vec.dot(vec.unit(F.col("v")), F.col("rv"))))
    return x.select("utt_id", "discussion", F.col("speaker").alias("kind"), "score")


def adaptive_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _typed(spark, sf_dir)
    return _rounded(scoring.decide(scores, scoring.adaptive_threshold(scores, KIND)), "threshold").drop("discussion")


def decision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _typed(spark, sf_dir)
    fixed = spark.range(1).select(F.lit(0.05).alias("threshold"))
    return _rounded(scoring.decision_stats(scoring.decide(scores, fixed)), "pct_same")


def score_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the scores against the reference by kind of speaker."""
    return _rounded(scoring.five_numbers(_typed(spark, sf_dir)), "low", "q1", "median", "q3", "high")


def best_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("quality", F.coalesce("duration", F.lit(0.0)))
    return _rounded(scoring.best_reference(s.select("utt_id", "v", "quality")), "quality_norm", "similarity_norm", "combined")


def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 bins of the scores against the reference over [-1, 1]."""
    b = F.least(F.greatest(F.floor((F.col("score") + 1) * 15), F.lit(0)), F.lit(29))
    return _typed(spark, sf_dir).groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def similarity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile pairs by the report's colour bands."""
    s = F.col("sim")
    band = F.when(s < 0, "-1..0").when(s < 0.2, "0..0.2").when(s < 0.4, "0.2..0.4").when(s < 0.6, "0.4..0.6").when(s < 0.8, "0.6..0.8").otherwise("0.8..1")
    return profile_topk_inter(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


QUERIES = {
    "profile_topk_intra": profile_topk_intra, "profile_topk_inter": profile_topk_inter, "pairs_intra_stats": pairs_intra_stats,
    "pairs_inter_stats": pairs_inter_stats, "mean_inter": mean_inter, "profile_longest_k": profile_longest_k,
    "profile_longest_inter": profile_longest_inter, "profile_weighted": profile_weighted, "split_half": split_half_centroid,
    "weighted_inter": weighted_inter, "clusters": clusters, "reciprocity": reciprocity, "triads": triads, "level_counts": level_counts,
    "cooccurrence_matrix": cooccurrence_matrix, "topn_network": topn_network, "in_degree": in_degree, "score_cosine": _score("cosine"),
    "score_snorm": _score("snorm"), "score_asnorm": _score("asnorm"), "score_adnorm": _score("adnorm"), "best_reference": best_reference,
    "adaptive_decision": adaptive_decision, "decision_stats": decision_stats, "similarity_histogram": similarity_histogram,
    "similarity_bands": similarity_bands, "score_boxes": score_boxes,
}

# --- SQL -------------------------------------------------------------------------------------------------------------

REF = "(SELECT min(utt_id) FROM s)"
_PARTS = "'^(.*)_([^_]*)_([^_]*)$'"
_S = ORDINALS_SQL + f""", newest AS (SELECT utt_id, CAST(arg_max(v, line_no) AS DOUBLE[]) AS v FROM utterance_vectors
  WHERE utt_id IS NOT NULL AND line_no IS NOT NULL AND v IS NOT NULL AND (utt_id, line_no) IN (SELECT (utt_id, max(line_no)) FROM utterance_vectors GROUP BY utt_id) GROUP BY utt_id),
valid AS (SELECT utt_id, v, regexp_extract(utt_id, {_PARTS}, 1) AS discussion, regexp_extract(utt_id, {_PARTS}, 2) AS speaker FROM newest
  WHERE len(v) = {DIM} AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT discussion, valid.speaker, valid.utt_id, v, duration FROM valid LEFT JOIN u ON u.utt_id = valid.utt_id)"""


def _mean(name: str, source: str, weight: str = "1.0", vector: str = "v", where: str = "TRUE", key: str = "discussion") -> str:
    return f""", {name} AS (SELECT {key}, list(m ORDER BY i) AS p FROM (
  SELECT {key}, i, sum({vector}[i] * {weight}) / sum({weight}) AS m FROM {source}, unnest(range(1, 193)) AS u(i) WHERE {where} GROUP BY ALL) GROUP BY {key})"""


_BY_CENTROID = _S + _mean("c", "s") + """, r AS (SELECT s.*, row_number() OVER (PARTITION BY s.discussion
  ORDER BY round(list_cosine_similarity(v, p), 12) DESC, utt_id) AS rk FROM s JOIN c USING (discussion))"""
_BY_DURATION = _S + ", r AS (SELECT *, row_number() OVER (PARTITION BY discussion ORDER BY duration DESC, utt_id) AS rk FROM s WHERE duration IS NOT NULL)"
_PROFILE = _mean("f", "r", where=f"rk <= {K}")
_INTRA = f"""SELECT m.discussion, members, n_segments, {{extra}}
  round(coalesce(mean_sim, 1.0), 6) + 0.0 AS mean_sim, round(min_sim, 6) + 0.0 AS min_sim, round(max_sim, 6) + 0.0 AS max_sim,
  round(std_sim, 6) + 0.0 AS std_sim, coalesce(n_evaluated, 0) AS n_evaluated
FROM (SELECT discussion, string_agg(CAST(utt_id AS VARCHAR), ',' ORDER BY rk) FILTER (rk <= {K}) AS members, count(*) AS n_segments,
             sum(duration) FILTER (rk <= {K}) AS profile_seconds FROM r GROUP BY discussion) m
LEFT JOIN (SELECT discussion, avg(x) AS mean_sim, min(x) AS min_sim, max(x) AS max_sim, stddev_pop(x) AS std_sim, count(x) AS n_evaluated
           FROM (SELECT r.discussion, list_cosine_similarity(v, p) AS x FROM r JOIN f USING (discussion) WHERE rk > {K}) GROUP BY discussion) t
  ON t.discussion = m.discussion"""


def _inter(profile: str) -> str:
    return f"""SELECT a.discussion AS ref, b.discussion AS target, round(list_cosine_similarity(a.p, b.p), 6) + 0.0 AS sim
FROM {profile} a JOIN {profile} b ON a.discussion <> b.discussion"""


_PAIRS = _S + """, x AS (SELECT a.discussion AS ref, b.discussion AS target, list_cosine_similarity(a.v, b.v) AS x FROM s a JOIN s b
  ON a.discussion <> b.discussion OR a.utt_id < b.utt_id)"""
_PAIR_STATS = """count(*) AS n_pairs, round(avg(x), 6) + 0.0 AS mean_sim, round(min(x), 6) + 0.0 AS min_sim, round(max(x), 6) + 0.0 AS max_sim,
  round(stddev_pop(x), 6) + 0.0 AS std_sim"""


def _halves(weight: str) -> str:
    return (
        _S
        + ", h AS (SELECT *, (row_number() OVER (PARTITION BY discussion ORDER BY utt_id) - 1) % 2 AS half FROM s)"
        + _mean("e", "h", weight, where="half = 0") + _mean("odd", "h", weight, where="half = 1") + _mean("w", "s", weight)
        + """ SELECT w.discussion, n AS n_segments, round(coalesce(list_cosine_similarity(e.p, odd.p), 1.0), 6) + 0.0 AS split_half,
  round(own, 6) + 0.0 AS segment_vs_profile FROM w JOIN e USING (discussion) LEFT JOIN odd USING (discussion)
  JOIN (SELECT s.discussion, count(*) AS n, avg(list_cosine_similarity(v, p)) AS own FROM s JOIN w USING (discussion) GROUP BY s.discussion) q USING (discussion)"""
    )


_GRAPH = _BY_CENTROID + _PROFILE + f""", i AS (SELECT discussion AS ref, round(coalesce(avg(x), 1.0), 6) + 0.0 AS threshold FROM (
  SELECT r.discussion, CASE WHEN rk > {K} THEN list_cosine_similarity(v, p) END AS x FROM r JOIN f USING (discussion)) GROUP BY discussion HAVING count(*) >= 2),
p AS ({_inter("f")}),
e AS (SELECT p.ref, p.target, sim, threshold FROM p JOIN i USING (ref) WHERE sim > threshold),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY sim DESC, target) AS rank FROM p) WHERE rank <= {NETWORK}),
l AS (SELECT n.ref, n.target, CASE WHEN b.ref IS NULL THEN 2 WHEN EXISTS (SELECT 1 FROM e x JOIN e y ON x.target = y.ref
        WHERE x.ref = n.ref AND y.target = n.target AND x.target <> n.target AND x.target <> n.ref) THEN 3 ELSE 1 END AS level
      FROM e AS n LEFT JOIN e b ON b.ref = n.target AND b.target = n.ref)"""

_SCORES = _S + f""", q AS (SELECT v AS rv FROM s WHERE utt_id = {REF}),
z AS (SELECT a.utt_id, b.utt_id AS imp, list_cosine_similarity(a.v, b.v) AS c FROM s a JOIN s b ON b.utt_id <> {REF}),
coh AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY round(c, 12) DESC, CAST(imp AS VARCHAR)) AS k FROM z),
k AS (SELECT utt_id, list_cosine_similarity(v, rv) AS cos FROM s, q)"""


def _norm_sql(where: str) -> str:
    return _SCORES + f""", m AS (SELECT utt_id, avg(c) AS mu, stddev_samp(c) AS sd FROM coh WHERE {where} GROUP BY utt_id)
SELECT CAST(k.utt_id AS VARCHAR) AS utt_id, round(x, 6) + 0.0 AS score, x > 2.0 AS same_speaker FROM (
  SELECT k.utt_id, ((cos - r.mu) / r.sd + (cos - m.mu) / m.sd) * 0.5 AS x FROM k JOIN m USING (utt_id), (SELECT mu, sd FROM m WHERE utt_id = {REF}) r) k"""  # fmt: skip


_TYPED = _S + f""", q AS (SELECT v AS rv FROM s WHERE utt_id = {REF}),
y AS (SELECT utt_id, discussion, speaker AS kind, round(list_cosine_similarity(v, rv), 6) + 0.0 AS score FROM s, q)"""
_INTER_TOPK = _BY_CENTROID + _PROFILE + _inter("f")

SQL = {
    "profile_topk_intra": _BY_CENTROID + _PROFILE + _INTRA.format(extra=""),
    "profile_topk_inter": _INTER_TOPK,
    "profile_longest_k": _BY_DURATION + _PROFILE + _INTRA.format(extra="round(profile_seconds, 6) + 0.0 AS profile_seconds,"),
    "profile_longest_inter": _BY_DURATION + _PROFILE + _inter("f"),
    "pairs_intra_stats": _PAIRS + f"SELECT ref AS discussion, {_PAIR_STATS} FROM x WHERE ref = target GROUP BY ref",
    "pairs_inter_stats": _PAIRS + f"SELECT ref, target, {_PAIR_STATS} FROM x WHERE ref <> target GROUP BY ref, target",
    "mean_inter": _PAIRS + "SELECT ref, target, round(avg(x), 6) + 0.0 AS mean_sim FROM x WHERE ref <> target GROUP BY ref, target",
    "profile_weighted": _halves("coalesce(duration, 2.0)"),
    "split_half": _halves("1.0"),
    "weighted_inter": _S + _mean("w", "s", "coalesce(duration, 2.0)") + _inter("w"),
    "clusters": _GRAPH + """SELECT i.ref, i.threshold, count(e.target) AS n_members, coalesce(string_agg(e.target, ',' ORDER BY e.target), '') AS members
FROM i LEFT JOIN e ON e.ref = i.ref GROUP BY i.ref, i.threshold""",
    "reciprocity": _GRAPH + "SELECT e.ref, e.target, b.ref IS NOT NULL AS reciprocal FROM e LEFT JOIN e b ON b.ref = e.target AND b.target = e.ref",
    "triads": _GRAPH + "SELECT ref, target, level FROM l",
    "level_counts": _GRAPH + "SELECT ref, count(*) FILTER (level = 1) AS n_reciprocal, count(*) FILTER (level = 2) AS n_dominant, count(*) FILTER (level = 3) AS n_triad FROM l GROUP BY ref",
    "cooccurrence_matrix": _GRAPH + "SELECT ref, string_agg(target || '=' || level, ',' ORDER BY target) AS row FROM l GROUP BY ref",
    "topn_network": _GRAPH + "SELECT n.ref, n.target, n.rank, n.sim AS score, b.ref IS NOT NULL AS reciprocal FROM n LEFT JOIN n b ON b.ref = n.target AND b.target = n.ref",
    "in_degree": _GRAPH + "SELECT d.discussion AS node, count(n.ref) AS n_in FROM (SELECT DISTINCT discussion FROM s) d LEFT JOIN n ON n.target = d.discussion GROUP BY d.discussion",
    "score_cosine": _SCORES + "SELECT CAST(utt_id AS VARCHAR) AS utt_id, round(cos, 6) + 0.0 AS score, cos >= 0.1 AS same_speaker FROM k",
    "score_snorm": _norm_sql("TRUE"),
    "score_asnorm": _norm_sql(f"k <= {COHORT_K}"),
    "score_adnorm": _SCORES + f""", m AS (SELECT coh.utt_id, avg(list_avg(s.v)) AS m FROM coh JOIN s ON s.utt_id = coh.imp WHERE k <= {COHORT_K} GROUP BY coh.utt_id),
d AS (SELECT s.utt_id, list_transform(v, lambda x: x - m.m) AS v FROM s JOIN m USING (utt_id))
SELECT CAST(d.utt_id AS VARCHAR) AS utt_id, round(x, 6) + 0.0 AS score, x > 0.75 AS same_speaker
FROM (SELECT d.utt_id, list_cosine_similarity(r.v, d.v) AS x FROM d, (SELECT v FROM d WHERE utt_id = {REF}) r) d""",
    "best_reference": _S + """, w AS (SELECT utt_id, coalesce(duration, 0.0) AS quality, v, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS w FROM s),
c AS (SELECT list(m ORDER BY i) AS p FROM (SELECT i, avg(w.w[i]) AS m FROM w, unnest(range(1, 193)) AS x(i) GROUP BY i)),
y AS (SELECT utt_id, quality, list_cosine_similarity(v, p) AS sim FROM w, c),
z AS (SELECT utt_id, (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER () + 1e-10) AS similarity_norm,
      (quality - min(quality) OVER ()) / (max(quality) OVER () - min(quality) OVER () + 1e-10) AS quality_norm FROM y),
g AS (SELECT *, 0.4 * similarity_norm + 0.6 * quality_norm AS combined FROM z)
SELECT row_number() OVER (ORDER BY round(combined, 12) DESC, utt_id) AS rank, utt_id, round(quality_norm, 6) + 0.0 AS quality_norm,
  round(similarity_norm, 6) + 0.0 AS similarity_norm, round(combined, 6) + 0.0 AS combined FROM g ORDER BY round(combined, 12) DESC, utt_id LIMIT 10""",
    "adaptive_decision": _TYPED + """, h AS (SELECT CASE WHEN count(*) > 5 THEN greatest(0.45, avg(score) - 0.5 * stddev_pop(score)) ELSE 0.50 END AS threshold FROM y WHERE kind = 'operateur')
SELECT utt_id, kind, score, round(threshold, 6) + 0.0 AS threshold, score >= threshold AS same_speaker FROM y, h""",
    "decision_stats": _TYPED + """SELECT kind, discussion, count(*) FILTER (score >= 0.05) AS n_same, count(*) FILTER (score < 0.05) AS n_diff, count(*) AS n,
  round(100.0 * count(*) FILTER (score >= 0.05) / count(*), 6) + 0.0 AS pct_same FROM y GROUP BY GROUPING SETS ((kind), (discussion), ())""",
    "score_boxes": _TYPED + """SELECT kind, count(score) AS n, round(min(score), 6) + 0.0 AS low, round(quantile_cont(score, 0.25), 6) + 0.0 AS q1,
  round(quantile_cont(score, 0.5), 6) + 0.0 AS median, round(quantile_cont(score, 0.75), 6) + 0.0 AS q3, round(max(score), 6) + 0.0 AS high FROM y GROUP BY kind""",
    "similarity_histogram": _TYPED + "SELECT CAST(least(greatest(floor((score + 1) * 15), 0), 29) AS BIGINT) AS bin, count(*) AS n FROM y GROUP BY 1",
    "similarity_bands": f"""WITH i AS ({_INTER_TOPK}) SELECT CASE WHEN sim < 0 THEN '-1..0' WHEN sim < 0.2 THEN '0..0.2' WHEN sim < 0.4 THEN '0.2..0.4'
  WHEN sim < 0.6 THEN '0.4..0.6' WHEN sim < 0.8 THEN '0.6..0.8' ELSE '0.8..1' END AS band, count(*) AS n FROM i GROUP BY 1""",
}
