import itertools
import math
import random

import numpy as np
import pytest
from conftest import rows

from parolis.functions import vec
from parolis.operators import graph, profiles, scoring
from pyspark.sql import functions as F

SCHEMA = "discussion string, utt_id bigint, v array<double>, duration double"


def corpus(n=24, d=5, seed=1, calls=3):
    r = random.Random(seed)
    return [(f"d{i % calls}", i, [r.gauss(0, 1) for _ in range(d)], r.choice([None, 1.0, 2.5, 4.0])) for i in range(n)]


def cos(a, b):
    na, nb = (max(math.sqrt(sum(x * x for x in v)), 1e-8) for v in (a, b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb)


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = rows(df.select(vec.cosine(F.col("a"), F.col("b")).alias("c"), vec.norm(F.col("a")).alias("n"), vec.unit(F.col("a")).alias("u")))
    assert got == [(0.0, 0.0, [0.0, 0.0]), (0.96, 5.0, [0.6, 0.8])]


def test_mean_vector_weighted(spark):
    df = spark.createDataFrame([([1.0, 0.0], 1.0), ([0.0, 2.0], 3.0)], "v array<double>, w double")
    plain, weighted = df.agg(vec.mean_vector(F.col("v")), vec.mean_vector(F.col("v"), F.col("w"))).first()
    assert plain == [0.5, 1.0] and weighted == [0.25, 1.5]


def test_topk_profile_against_numpy(spark):
    data = corpus()
    s = spark.createDataFrame(data, SCHEMA).drop("duration")
    top = profiles.top_by_centroid(s, 3)
    got = {r.discussion: r for r in profiles.intra(s, top, profiles.profiles(s, top)).collect()}
    for d in got:
        own = [(u, np.array(v)) for c, u, v, _ in data if c == d]
        centroid = np.mean([v for _, v in own], axis=0)
        order = sorted(own, key=lambda x: (-round(cos(x[1], centroid), 12), x[0]))
        p = np.mean([v for _, v in order[:3]], axis=0)
        sims = [cos(v, p) for _, v in order[3:]]
        assert got[d].members == ",".join(str(u) for u, _ in order[:3])
        assert got[d].mean_sim == pytest.approx(np.mean(sims)) and got[d].std_sim == pytest.approx(np.std(sims))


def test_profile_of_few_segments_means_one(spark):
    data = [("a", 1, [1.0, 0.0], 1.0), ("a", 2, [0.0, 1.0], 1.0), ("b", 3, [1.0, 1.0], 1.0)]
    s = spark.createDataFrame(data, SCHEMA)
    top = profiles.top_by_centroid(s, 3)
    got = rows(profiles.intra(s, top, profiles.profiles(s, top)), "discussion", "mean_sim", "std_sim", "n_evaluated")
    assert got == [("a", 1.0, None, 0), ("b", 1.0, None, 0)]


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_pair_statistics_in_blocks(spark, block):
    data = corpus(15)
    got = {(r.ref, r.target): r for r in profiles.pair_statistics(spark.createDataFrame(data, SCHEMA), block).collect()}
    for a, b in itertools.product(["d0", "d1", "d2"], repeat=2):
        s = [cos(x[2], y[2]) for x in data for y in data if x[0] == a and y[0] == b and (a != b or x[1] < y[1])]
        r = got[a, b]
        assert (r.n_pairs, r.mean_sim, r.min_sim) == (len(s), pytest.approx(np.mean(s)), pytest.approx(min(s)))
        assert r.std_sim == pytest.approx(np.std(s), abs=1e-9)


def test_split_half(spark):
    data = [("a", i, v, 1.0) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0]])] + [("b", 9, [1.0, 1.0], None)]
    got = rows(profiles.split_half(spark.createDataFrame(data, SCHEMA)), "discussion", "split_half")
    assert got[0] == ("a", 0.0) and got[1] == ("b", 1.0)


def brute_levels(edges):
    e = set(edges)
    nodes = {x for p in e for x in p}
    out = {}
    for a, b in e:
        if (b, a) not in e:
            out[a, b] = 2
        else:
            out[a, b] = 3 if any((a, c) in e and (c, b) in e for c in nodes - {a, b}) else 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_levels_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [p for p in itertools.permutations("abcdef", 2) if r.random() < 0.35] + [("x", "y"), ("y", "x")]
    got = graph.with_levels(spark.createDataFrame(edges, "ref string, target string"))
    assert {(r.ref, r.target): r.level for r in got.collect()} == brute_levels(edges)


def test_clusters_in_degree_and_matrix(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5), ("b", "a", 0.4)], "ref string, target string, sim double")
    thresholds = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "ref string, threshold double")
    assert rows(graph.clusters(pairs, thresholds), "ref", "n_members", "members") == [("a", 1, "b"), ("b", 0, "")]
    nodes = spark.createDataFrame([("a",), ("b",), ("z",)], "node string")
    assert rows(graph.in_degree(pairs, nodes), "node", "n_in") == [("a", 1), ("b", 1), ("z", 0)]
    levels = graph.with_levels(pairs)
    assert rows(graph.matrix(levels, ["a", "b", "c"])) == [("a", 0, 1, 2), ("b", 1, 0, 0)]
    assert rows(graph.level_counts(levels)) == [("a", 1, 1, 0), ("b", 1, 0, 0)]


def test_matrix_holds_every_label(spark):
    names = [f"label {i:02d}" for i in range(30)]
    edges = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "ref string, target string")
    got = {r.ref: r.row.split(",") for r in graph.sparse_matrix(graph.with_levels(edges)).collect()}
    assert len(got) == 29 and got["label 00"] == [f"{n}=2" for n in names[1:]]
    wide = graph.matrix(graph.with_levels(edges), names)
    assert wide.columns == ["ref"] + [f"t_{n}" for n in names]


def test_nearest_profiles_and_cohort_moments(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((40, 6))
    v[7] = 3 * v[5]  # a tie for everyone
    df = spark.createDataFrame([(f"d{i:02d}", x.tolist()) for i, x in enumerate(v)], "discussion string, profile array<double>")
    got = {(r.ref, r["rank"]): r.target for r in profiles.nearest_profiles(df, 4, block=7).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (u @ u.T).round(12)
    for i in range(40):
        want = sorted((-s[i, j], f"d{j:02d}") for j in range(40) if j != i)[:4]
        assert [got[f"d{i:02d}", k + 1] for k in range(4)] == [t for _, t in want]
    corpus = df.withColumnsRenamed({"discussion": "utt_id", "profile": "v"}).repartition(5)
    stats = {r.utt_id: r for r in scoring._cohort_stats(corpus, "d03").collect()}
    others = np.delete(u, 3, axis=0)
    for i in range(40):
        c = others @ u[i]
        assert stats[f"d{i:02d}"].mu == pytest.approx(c.mean()) and stats[f"d{i:02d}"].sigma == pytest.approx(c.std(ddof=1)) and stats[f"d{i:02d}"].n == 39



def test_snorm_ignores_scale_and_asnorm_needs_a_cohort(spark):
    data = [(str(i), v) for _, i, v, _ in corpus(12)]
    df = spark.createDataFrame(data, "utt_id string, v array<double>")
    base = rows(scoring.search(df, "3", "snorm"), "utt_id", "score")
    scaled = rows(scoring.search(df.withColumn("v", F.transform("v", lambda x: x * 7)), "3", "snorm", block=5), "utt_id", "score")
    assert [u for u, _ in base] == [u for u, _ in scaled]
    assert np.allclose([s for _, s in base], [s for _, s in scaled])
    with pytest.raises(ValueError, match="cohort"):
        scoring.search(df, "3", "asnorm", k=12)


def test_asnorm_and_adnorm_against_numpy(spark):
    data = [(str(i), np.array(v)) for _, i, v, _ in corpus(14, seed=4)]
    df = spark.createDataFrame([(u, v.tolist()) for u, v in data], "utt_id string, v array<double>")
    ref = dict(data)["5"]
    cohort = [(u, v) for u, v in data if u != "5"]

    def top(v, k=4):
        return sorted(cohort, key=lambda c: (-round(cos(v, c[1]), 12), c[0]))[:k]

    got = dict(rows(scoring.search(df, "5", "asnorm", 4, block=6), "utt_id", "score"))
    vector = dict(rows(scoring.search(df, "5", "adnorm", 4, mode="vector"), "utt_id", "score"))
    for u, v in data:
        e, t = ([cos(x, c) for _, c in top(x)] for x in (ref, v))
        s = cos(ref, v)
        assert got[u] == pytest.approx(((s - np.mean(e)) / np.std(e, ddof=1) + (s - np.mean(t)) / np.std(t, ddof=1)) / 2)
        mean = lambda x: np.mean([c for _, c in top(x)], axis=0)
        assert vector[u] == pytest.approx(cos(ref - mean(ref), v - mean(v)))


def test_adaptive_threshold(spark):
    many = spark.createDataFrame([("k", 0.8), ("k", 0.9)] * 4, "kind string, score double")
    few = spark.createDataFrame([("k", 0.9)] * 5, "kind string, score double")
    assert scoring.adaptive_threshold(many, "k").first()[0] == pytest.approx(0.85 - 0.025)
    assert scoring.adaptive_threshold(few, "k").first()[0] == 0.5
