import numpy as np
import pytest
from conftest import rows
from test_similarity import brute_levels

from parolis.operators import graph, links


@pytest.fixture
def profiles(spark, monkeypatch):
    """Profiles in several blocks, one without a threshold, and their links by brute force."""
    monkeypatch.setattr(links, "BLOCK", 7)
    rng = np.random.default_rng(5)
    v, w = rng.standard_normal((40, 6)), rng.uniform(-0.2, 0.6, 40).round(6)
    w[3], w[4], v[9] = float("nan"), 2.0, 3 * v[8]
    names = [f"d{i:02d}" for i in rng.permutation(40)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (u @ u.T).round(6)
    edges = [(names[i], names[j]) for i in range(40) for j in range(40) if i != j and s[i, j] > w[i]]
    df = spark.createDataFrame([(n, x.tolist(), float(t)) for n, x, t in zip(names, v, w)], "key string, v array<double>, w double").repartition(3)
    return df, edges, dict(zip(names, w))


def no_pairs_shuffled(df):
    p = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(x in p for x in ("Aggregate", "Window", "Generate", "RepartitionByExpression")) and p.count("Join") == 1  # the product of blocks


def test_triads(spark, profiles):
    df, edges, _ = profiles
    got = links.levels(df)
    assert no_pairs_shuffled(got)
    assert {(r.ref, r.target): r.level for r in got.collect()} == brute_levels(edges)
    assert {r.level for r in got.collect()} == {1, 2, 3}


@pytest.mark.parametrize("few", [0.0, 1.0])
def test_triads_by_product_and_by_pair_agree(few, monkeypatch):
    monkeypatch.setattr(links, "FEW", few)
    monkeypatch.setattr(links, "CHUNK", 13)
    rng = np.random.default_rng(2)
    a, b, asked = rng.random((9, 37)) < 0.2, rng.random((6, 37)) < 0.2, rng.random((9, 6)) < 0.7
    got = links.middle(np.packbits(a, axis=1), np.packbits(b, axis=1), asked)
    assert (got == (asked & (a.astype(int) @ b.T.astype(int) > 0))).all()


def test_matrix_of_all_profiles(spark, profiles):
    df, edges, _ = profiles
    got = links.sparse_matrix(df)
    assert no_pairs_shuffled(got)
    want = graph.sparse_matrix(graph.with_levels(spark.createDataFrame(edges, "ref string, target string")))
    assert rows(got) == rows(want)


def test_level_counts_of_all_profiles(spark, profiles):
    df, edges, _ = profiles
    got = links.level_counts(df)
    assert no_pairs_shuffled(got)
    want = graph.level_counts(graph.with_levels(spark.createDataFrame(edges, "ref string, target string")))
    assert rows(got) == rows(want)


def test_reciprocity_of_all_profiles(spark, profiles):
    df, edges, _ = profiles
    got = links.reciprocity(df)
    assert no_pairs_shuffled(got)
    assert rows(got) == rows(graph.with_reciprocal(spark.createDataFrame(edges, "ref string, target string")))


def test_clusters_of_all_profiles(spark, profiles, monkeypatch):
    monkeypatch.setattr(links, "BYTES", 100)
    df, edges, thresholds = profiles
    got = links.clusters(df)
    assert no_pairs_shuffled(got)
    found = {r.ref: (r.threshold, r.n_members, r.members) for r in got.collect()}
    own = {n: sorted(b for a, b in edges if a == n) for n, t in thresholds.items() if t == t}
    assert len(own) == 39 and found == {n: (pytest.approx(thresholds[n]), len(m), ",".join(m)) for n, m in own.items()}
