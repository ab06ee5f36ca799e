import random

import pytest
from conftest import rows

from parolis.operators.intervals import merged_periods, periods_and_gaps

SCHEMA = "who string, s bigint, e bigint"


def brute(data, max_gap=None):
    out = []
    for who in sorted({w for w, s, e in data if w is not None}):
        spans = sorted((s, e) for w, s, e in data if w == who and s is not None and e is not None and e > s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(who, "period", a, b) for a, b in merged]
        out += [(who, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if max_gap is None or b[0] - a[1] <= max_gap]
    return sorted(out, key=lambda t: tuple((x is not None, str(x)) for x in t))


@pytest.mark.parametrize("width", [7, 50, 100_000])
def test_against_brute_force(spark, width):
    r = random.Random(width)
    data = [(r.choice("abbb"), s := r.randint(-50, 400), s + r.choice([0, -3, 1, 2, 5, 40, 120])) for _ in range(300)]
    data += data[:20] + [(None, 1, 5), ("a", None, 4), ("b", 4, None)]
    got = periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["who"], "s", "e", max_gap=6, slice_width=width)
    assert rows(got, "who", "kind", "start_ms", "end_ms") == brute(data, 6)


def test_touching_nested_and_carried_over_slices(spark):
    data = [("a", 0, 1000), ("a", 10, 20), ("a", 1000, 1001), ("a", 1500, 1600), ("a", 1500, 1600)]
    got = rows(merged_periods(spark.createDataFrame(data, SCHEMA), ["who"], "s", "e", 100), "island", "period_start", "period_end", "gap_start")
    assert got == [(1, 0, 1001, None), (2, 1500, 1600, 1001)]


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(empty, ["who"], "s", "e").count() == 0
    odd = spark.createDataFrame([("a", 1, 5, "x", 9, 9)], "who string, s bigint, e bigint, slice string, island bigint, k0 bigint")
    assert rows(periods_and_gaps(odd, ["who"], "s", "e"), "who", "kind", "start_ms", "end_ms") == [("a", "period", 1, 5)]
