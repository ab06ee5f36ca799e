import math

import numpy as np
import pytest

from parolis.llm.hnsw import Graph
from parolis.llm.neighbours import GUEST, LATE, MEMBER, OTHER, grouped, nearest_vectors, similar_pairs

DIM = 24


def voices(n=400, groups=40, seed=0, noise=0.12):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, DIM))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    v = centre[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, DIM))
    return (v * rng.uniform(0.5, 40, (n, 1))).astype(np.float32)


def brute(ids, v, k=5, least=0.7):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = (u @ u.T).round(6)
    out = set()
    for i in range(len(ids)):
        order = sorted((-c[i, j], ids[j], j) for j in range(len(ids)) if j != i)[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for s, _, j in order if -s >= least}
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "utt_id string, line_no bigint, v array<float>")


def found(df):
    return {(r.utt_a, r.utt_b) for r in df.collect()}


def test_equals_brute_force_on_one_shard(spark):
    v = voices()
    ids = [f"u{i:04d}" for i in range(len(v))]
    df = frame(spark, [(u, i, x.tolist()) for i, (u, x) in enumerate(zip(ids, v))])
    want = brute(ids, v)
    got = found(similar_pairs(df, dim=DIM))
    assert got <= want | got and len(got & want) / len(want) > 0.99 and len(got - want) / len(want) < 0.01


def test_recall_over_routed_shards(spark):
    v = voices(1500, 150, seed=3)
    ids = [f"u{i:04d}" for i in range(len(v))]
    df = frame(spark, [(u, i, x.tolist()) for i, (u, x) in enumerate(zip(ids, v))])
    want = brute(ids, v)
    got = found(similar_pairs(df, dim=DIM, capacity=600))
    assert len(got & want) / len(want) >= 0.9


def test_hot_voice_is_split(spark):
    rng = np.random.default_rng(5)
    hot = np.ones((300, DIM)) + 0.3 * rng.standard_normal((300, DIM))
    v = np.concatenate([hot, voices(100, 20, seed=6)]).astype(np.float32)
    ids = [f"u{i:04d}" for i in range(len(v))]
    df = frame(spark, [(u, i, x.tolist()) for i, (u, x) in enumerate(zip(ids, v))])
    want = brute(ids, v)
    got = found(similar_pairs(df, dim=DIM, capacity=80))
    assert len(got & want) / len(want) >= 0.9


def test_groups_of_a_cell_of_ten_times_the_capacity(spark):
    """Every two members and every guest and member meet in exactly one group, and no group is larger than the capacity."""
    capacity, members, guests = 100, 1000, 260
    data = [(7, MEMBER, f"m{i}") for i in range(members)] + [(7, GUEST, f"g{i}") for i in range(guests)] + [(8, MEMBER, f"n{i}") for i in range(40)] + [(8, GUEST, f"h{i}") for i in range(9)]
    rows_ = spark.createDataFrame(data, "cell int, role int, id string").selectExpr("*", "array(1.0f) AS v")
    got = grouped(rows_, {(7, MEMBER): members, (7, GUEST): guests, (8, MEMBER): 40, (8, GUEST): 9}, capacity).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.cell, r.part, r.other), []).append((r.id, r.role))
    assert max(map(len, groups.values())) <= 1.5 * capacity  # hashing is not quite even
    assert sorted(r for _, r in groups[8, 0, 0]) == [MEMBER] * 40 + [GUEST] * 9
    met = {}
    for g in groups.values():
        here, other = [i for i, r in g if r == MEMBER], [i for i, r in g if r == OTHER]
        asking = [i for i, r in g if r in (GUEST, LATE)]
        pairs = [(a, b) for a in here for b in other or ([] if LATE in {r for _, r in g} else here) if a != b] + [(a, b) for a in asking for b in here]
        for a, b in pairs:
            met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + (1 if (a in other or b in other or a in asking or b in asking or other) else 0.5)
    assert set(met.values()) == {1} and len(met) == members * (members - 1) // 2 + members * guests + 40 * 39 // 2 + 40 * 9


@pytest.mark.parametrize("cells", [1, 16, 64])
def test_recall_by_number_of_cells(spark, cells):
    v = voices(2400, 240, seed=4, noise=0.1)
    ids = [f"u{i:04d}" for i in range(len(v))]
    df = frame(spark, [(u, i, x.tolist()) for i, (u, x) in enumerate(zip(ids, v))])
    want = brute(ids, v)
    got = found(similar_pairs(df, dim=DIM, capacity=math.ceil(2 * len(v) / 0.6 / cells)))
    assert len(got & want) / len(want) >= 0.95


def test_voice_of_a_third_of_all_rows_over_routed_shards(spark):
    rng = np.random.default_rng(8)
    dim, n = 64, 2000
    centre = rng.standard_normal((201, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    voice = np.concatenate([np.zeros(n, int), rng.integers(1, 201, 2 * n)])
    v = (centre[voice] + 0.075 * rng.standard_normal((3 * n, dim))).astype(np.float32)
    ids = [f"u{i:04d}" for i in range(3 * n)]
    want = brute(ids, v)
    got = found(similar_pairs(frame(spark, [(u, i, x.tolist()) for i, (u, x) in enumerate(zip(ids, v))]), dim=dim, capacity=300))
    in_hot = {p for p in want if voice[int(p[0][1:])] == 0}
    assert len(in_hot & got) / len(in_hot) > 0.999
    assert len((want - in_hot) & got) / len(want - in_hot) > 0.9


def test_one_shard_of_one_voice():
    rng = np.random.default_rng(9)
    v = np.eye(64)[0] + 0.075 * rng.standard_normal((2500, 64))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b, _ = Graph(u).neighbours(5, 0.7)
    c = u @ u.T
    np.fill_diagonal(c, -1)
    want = {(i, int(j)) for i in range(2500) for j in np.argsort(-c[i])[:5] if c[i, j] >= 0.7}
    assert len(want) > 10_000 and len(want & set(zip(a.tolist(), b.tolist()))) / len(want) > 0.999


def test_copies_ties_and_many_equal_rows(spark):
    one = np.arange(1, DIM + 1, dtype=np.float32)
    data = [(f"c{i:03d}", i, (one * (1 + i % 3)).tolist()) for i in range(200)] + [("z", 999, (-one).tolist())]
    got = found(similar_pairs(frame(spark, data), dim=DIM))
    first = [f"c{i:03d}" for i in range(6)]
    want = {tuple(sorted((f"c{i:03d}", x))) for i in range(200) for x in [y for y in first if y != f"c{i:03d}"][:5]}
    assert got == want


def test_dirty_rows_and_versions(spark):
    a, b = [1.0] * DIM, [1.0] * (DIM - 1) + [0.5]
    data = [("a", 1, a), ("a", 2, b), ("b", 1, a), ("c", 1, None), ("d", 1, []), ("e", 1, a[:-1]), ("f", 1, [0.0] * DIM), ("g", 1, [float("nan")] + a[1:]),
            ("h", 1, a), ("h", 2, [float("inf")] + a[1:]), ("i", 1, [None] + a[1:]), (None, 1, a), ("k", None, a), ("b", 1, a)]
    df = frame(spark, data).selectExpr("*", "1 AS cell", "'x' AS id")
    got = nearest_vectors(df, dim=DIM).collect()
    assert {(r.a, r.b) for r in got} == {("a", "b"), ("b", "a")} and got[0].cos < 1
    assert similar_pairs(frame(spark, []), dim=DIM).count() == 0


def test_search_from_outside():
    v = voices(300).astype(np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    g = Graph(u[:250])
    row, to, cos = g.search(u[250:], 3, 0.7)
    c = (u[250:] @ u[:250].T).round(6)
    best = {i: c[i].max() for i in range(50) if c[i].max() >= 0.7}
    hit = {int(r): x for r, x in zip(row[::-1], cos[::-1])}
    assert sum(hit.get(i) == pytest.approx(s) for i, s in best.items()) / len(best) > 0.95
