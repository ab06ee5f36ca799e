import numpy as np
import pytest

from parolis.operators import blocks, scoring


@pytest.fixture
def vectors(spark):
    """Single-precision vectors with a voice of many near copies, exact and scaled ones among them."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((90, 12)).astype(np.float32)
    v[30:60] = v[30] + 1e-4 * rng.standard_normal((30, 12)).astype(np.float32)
    v[70], v[71], v[72] = v[5], 4 * v[5], v[40]
    names = [f"u{i:02d}" for i in rng.permutation(90)]
    df = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, v)], "utt_id string, v array<float>").repartition(4)
    return df, names, v.astype(np.float64)


def nearest(names, v, ref, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (u @ u.T).round(12)
    return {n: [i for _, _, i in sorted((-s[a, b], names[b], b) for b in range(len(v)) if names[b] != ref)[:k]] for a, n in enumerate(names)}, u


@pytest.mark.parametrize("right", [25, 1000])
def test_nearest_impostors_are_exact(spark, vectors, monkeypatch, right):
    monkeypatch.setattr(blocks, "RIGHT", right)
    monkeypatch.setattr(blocks, "TILE", 16)
    df, names, v = vectors
    want, u = nearest(names, v, "u07", 6)
    top = scoring._top_cohort(df, "u07", 6, 32)
    got = {r.utt_id: r for r in top.collect()}
    assert set(got) == set(names)
    for a, n in enumerate(names):
        assert got[n].impostors == [names[b] for b in want[n]]
        assert got[n].sims == pytest.approx([u[a] @ u[b] for b in want[n]]) and got[n].shades == pytest.approx([v[b].mean() for b in want[n]])
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    if right == 1000:
        assert not any(x in plan for x in ("Window", "Aggregate", "Generate", "RepartitionByExpression"))  # nothing is shuffled


def test_lists_are_not_shuffled_whatever_the_number_of_vectors(spark, vectors, monkeypatch):
    monkeypatch.setattr(blocks, "RIGHT", 25)
    monkeypatch.setattr(blocks, "OWN", 2, raising=False)  # more groups than TASKS
    df, names, v = vectors
    want, _ = nearest(names, v, "u07", 6)
    top = scoring._top_cohort(df, "u07", 6, 3)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Window", "Aggregate", "Generate", "Join", "RepartitionByExpression"))
    assert {r.utt_id: r.impostors for r in top.collect()} == {n: [names[b] for b in want[n]] for n in names}


def test_ties_do_not_pile_up():
    x = np.tile(np.arange(1.0, 5), (300, 1)).astype(np.float32)
    near = scoring._Nearest([f"u{i:03d}" for i in range(20)], x[:20], "u003", 4, ("impostors",))
    for a in (200, 100, 0):
        near.see([f"u{i:03d}" for i in range(a, a + 100)], x[:100])
    near._keep()
    assert len(near.found[0]) == 20 * 4
    (batch,) = near.end()
    assert batch.column("impostors").to_pylist() == [["u000", "u001", "u002", "u004"]] * 20


def test_adnorm_by_scalars(spark, vectors):
    df, names, v = vectors
    want, _ = nearest(names, v, "u07", 6)
    m = {n: np.mean([v[b].mean() for b in want[n]]) for n in names}
    search = scoring.search(df, "u07", "adnorm", 6, block=32)
    assert "impostors" not in search._jdf.queryExecution().optimizedPlan().toString()  # no vector or id of an impostor is joined
    got = {r.utt_id: r.score for r in search.collect()}
    ref = v[names.index("u07")] - m["u07"]
    for a, n in enumerate(names):
        x = v[a] - m[n]
        assert got[n] == pytest.approx(ref @ x / np.linalg.norm(ref) / np.linalg.norm(x))


@pytest.mark.parametrize("method, wanted", [("adnorm", "shades"), ("asnorm", "sims")])
def test_only_the_lists_of_a_score_are_carried(spark, vectors, monkeypatch, method, wanted):
    schemas, streamed = [], blocks.streamed
    monkeypatch.setattr(blocks, "streamed", lambda rows, block, visitor, schema: schemas.append(schema) or streamed(rows, block, visitor, schema))
    df, names, _ = vectors
    assert scoring.search(df, "u07", method, 6, block=32).count() == len(names)
    assert schemas == [f"utt_id string, {wanted} array<double>"]
