import itertools

import numpy as np
import pytest
from test_similarity import SCHEMA, corpus, cos

from parolis.operators import profiles


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def expected(data, a, b):
    return [cos(x[2], y[2]) for x in data for y in data if x[0] == a and y[0] == b and (a != b or x[1] < y[1])]


def test_statistics_inside_discussions_need_one_exchange(spark, monkeypatch):
    monkeypatch.setattr(profiles.blocks, "TILE", 3)
    data = corpus(23) + [("alone", 99, [1.0] * 5, None)]
    df = profiles.inner_statistics(spark.createDataFrame(data, SCHEMA))
    assert "Generate" not in plan(df) and plan(df).count("Repartition") == 1  # no copies of the rows
    got = {r.ref: r for r in df.collect()}
    assert set(got) == {"d0", "d1", "d2"}
    for d in got:
        s, r = expected(data, d, d), got[d]
        assert (r.target, r.n_pairs, r.mean_sim, r.min_sim, r.max_sim) == (d, len(s), pytest.approx(np.mean(s)), pytest.approx(min(s)), pytest.approx(max(s)))
        assert r.std_sim == pytest.approx(np.std(s), abs=1e-9)


def test_statistics_between_discussions_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(profiles.blocks, "TILE", 4)
    data = corpus(40, calls=4) + [("large", 100 + i, v, None) for i, (_, _, v, _) in enumerate(corpus(300, seed=3))]
    df = profiles.outer_statistics(spark.createDataFrame(data, SCHEMA), 16)
    assert not any(x in plan(df) for x in ("Aggregate", "Generate", "RepartitionByExpression"))
    got = {(r.ref, r.target): r for r in df.collect()}
    names = ["d0", "d1", "d2", "d3", "large"]
    assert len(got) == 20
    for a, b in itertools.permutations(names, 2):
        s, r = expected(data, a, b), got[a, b]
        assert (r.n_pairs, r.mean_sim, r.min_sim, r.max_sim) == (len(s), pytest.approx(np.mean(s)), pytest.approx(min(s)), pytest.approx(max(s)))
        assert r.std_sim == pytest.approx(np.std(s), abs=1e-9)


def test_pairs_between_discussions_are_formed_once_and_held_by_no_task(spark, monkeypatch):
    monkeypatch.setattr(profiles.blocks, "OWN", 3)  # more groups than TASKS
    data = corpus(90, calls=30) + [("large", 100 + i, v, None) for i, (_, _, v, _) in enumerate(corpus(40, seed=3))]
    df = profiles.outer_statistics(spark.createDataFrame(data, SCHEMA), 4)
    assert "Join" not in plan(df)  # no product whose right side is held
    found = df.collect()
    got = {(r.ref, r.target): r[2:] for r in found}
    assert len(found) == len(got) == 31 * 30
    for a, b in itertools.permutations(sorted({x[0] for x in data}), 2):
        s = expected(data, a, b)
        assert got[a, b] == got[b, a] == pytest.approx((len(s), np.mean(s), min(s), max(s), np.std(s)), abs=1e-9)


def test_both_ways_of_a_pair_are_written_close_together(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(f"d{i // 2:03d}", i, v.tolist(), None) for i, v in enumerate(rng.standard_normal((1000, 16)))]
    df = profiles.outer_statistics(spark.createDataFrame(data, SCHEMA), 250)
    df.write.parquet(str(tmp_path / "pairs"))
    bytes_a_row = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) / (500 * 499)
    assert bytes_a_row < 28  # four doubles are 32


def test_every_two_groups_meet_once():
    for count in range(1, 9):
        met = [frozenset((g, h)) for g in range(count) for h in profiles.blocks.half(g, count)]
        assert len(met) == len(set(met)) == count * (count - 1) // 2 and all(len(m) == 2 for m in met)


def test_statistics_are_rounded_half_up_without_a_negative_zero():
    got = profiles._half_up(np.array([0.1234565, -0.1234565, 0.5, -1e-9, 0.99999951]), 6)
    assert got.tolist() == [0.123457, -0.123457, 0.5, 0.0, 1.0] and not np.signbit(got[3])
