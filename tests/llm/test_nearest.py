import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st

from parolis.llm.nearest import LearnedIndex, nearest_by_time


@given(st.sets(st.integers(-10_000, 10_000), max_size=300), st.lists(st.integers(-11_000, 11_000), max_size=50), st.integers(1, 40))
def test_index_equals_binary_search(keys, queries, epsilon):
    k, q = np.array(sorted(keys), dtype=np.int64), np.array(queries, dtype=np.int64)
    if len(k) and len(q):
        assert (LearnedIndex(k, epsilon).lower_bound(q) == np.searchsorted(k, q)).all()


def test_pieces_keep_their_bound():
    k = np.unique(np.random.default_rng(1).integers(0, 10**7, 20_000) ** 2 // 10**6)
    i = LearnedIndex(k, 16)
    piece = np.searchsorted(i.firsts, k, side="right") - 1
    predicted = i.starts[piece] + i.slopes[piece] * (k - i.firsts[piece])
    assert np.abs(predicted - np.arange(len(k))).max() <= 16.5 and len(i.firsts) < 400


A, B = "ann bigint, call string, t bigint, entity string", "seg bigint, call string, u bigint, side int"


@pytest.mark.parametrize("width", [800, 5_000, 10_000_000])
def test_against_brute_force(spark, width):
    r = random.Random(width)
    left = [(i, r.choice(["a", "a", "b", None]), r.choice([None, r.randint(-9000, 9000)]), "x") for i in range(200)]
    right = [(i, r.choice(["a", "a", "b"]), r.choice([None, r.randint(-9000, 9000), 100]), 7) for i in range(120)]
    left, right = left + left[:10] + [(None, "a", 5, "x")], right + right[:10]
    want = set()
    for i, c, t, _ in left:
        near = [(abs(t - u), s) for s, d, u, _ in right if t is not None and u is not None and d == c and abs(t - u) <= 750]
        if near and i is not None:
            want.add((i, min(near)[1]))
    got = nearest_by_time(spark.createDataFrame(left, A), spark.createDataFrame(right, B), "call", "ann", "t", "seg", "u", 750, width)
    got = rows(got, "left_id", "right_id")
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_sides_and_tolerance(spark):
    left, right = spark.createDataFrame([(1, "a", 5, "x")], A), spark.createDataFrame([], B)
    assert nearest_by_time(left, right, "call", "ann", "t", "seg", "u", 750).count() == 0
    assert nearest_by_time(left.limit(0), spark.createDataFrame([(1, "a", 5, 0)], B), "call", "ann", "t", "seg", "u", 750).count() == 0
    with pytest.raises(ValueError):
        nearest_by_time(left, right, "call", "ann", "t", "seg", "u", 900, 800)
