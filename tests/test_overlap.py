import itertools
import random

import numpy as np
import pytest
from conftest import rows

from parolis.operators import overlap as O
from parolis.operators import turns as T


def test_overlapping_pairs_once(spark):
    r = random.Random(2)
    left = [("c", i, s := r.uniform(0, 300), s + r.uniform(0.1, 90)) for i in range(40)]
    right = [("c", i, s := r.uniform(0, 300), s + r.uniform(0.1, 90)) for i in range(40)]
    a = spark.createDataFrame(left, "audio_id string, l int, s double, e double")
    b = spark.createDataFrame(right, "audio_id string, r int, rs double, re double")
    for margin in (0.0, 3.0):
        want = sorted((i, j) for _, i, s, e in left for _, j, rs, re in right if rs < e + margin and re > s - margin)
        got = sorted((x.l, x.r) for x in O.overlapping(a, b, 20.0, margin).collect())
        assert got == want


def test_attribution_ties_and_default(spark):
    e = spark.createDataFrame([("c", 1, 0.0, 4.0), ("c", 2, 90.0, 91.0), ("x", 3, 0.0, 1.0)], "audio_id string, entity_id int, s double, e double")
    t = spark.createDataFrame([("c", "late", 2.0, 4.0), ("c", "early", 0.0, 2.0)], "audio_id string, speaker string, start double, end double")
    assert rows(O.attribute_speaker(e, t), "entity_id", "speaker", "overlap") == [(1, "early", 2.0), (2, "INCONNU", 0.0), (3, "INCONNU", 0.0)]


@pytest.mark.parametrize("shape", [(1, 1), (2, 4), (4, 2), (5, 5)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(3)
    for _ in range(20):
        g = rng.random(shape)
        n, m = shape
        best = max(sum(g[i, j] for i, j in zip(range(n), p)) if n <= m else sum(g[i, j] for i, j in zip(p, range(m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        pairs = O.assignment(g)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(n, m)
        assert sum(g[i, j] for i, j in pairs) == pytest.approx(best)


def test_diarisation_error_invariants(spark):
    ref = [("c", "A", 0.0, 10.0), ("c", "B", 8.0, 20.0), ("c", "A", 30.0, 300.0)]
    schema = "audio_id string, speaker string, start double, end double"
    r = spark.createDataFrame(ref, schema)
    same = spark.createDataFrame([(c, {"A": "1", "B": "0"}[s], a, b) for c, s, a, b in ref], schema)
    got = O.diarisation_error(r, same).first()
    assert got.total == pytest.approx(10 + 12 + 210) and got.der == pytest.approx(0)
    hyp = spark.createDataFrame([("c", "1", 0.0, 20.0)], schema)
    got = O.diarisation_error(r, hyp).first()
    # speaker 1 maps to B (12 s); A alone is confused for 8 s, its part of the overlap and the end are missed
    assert (got.missed, got.false_alarm, got.confusion) == (pytest.approx(212), 0, pytest.approx(8))
    none = O.diarisation_error(spark.createDataFrame([], schema), hyp).first()
    assert none.der is None and none.false_alarm == 20


def test_turn_numbers_filter_and_cut_list(spark):
    data = [("x/audio-1.2.WAV", 1, " Operateur", 0.0, 1.0), ("audio-1.2.wav", 2, "operateur", 2.0, 6.0), ("audio-1.2", 3, "operateur", 7.0, 9.0),
            ("audio-1.2", 4, "7", 9.0, 9.0), ("audio-1.2", 5, "7", 9.0, 12.5), (None, 1, "7", 0.0, 1.0), ("audio-1.2", 6, None, 0.0, 1.0)]
    t = T.valid_turns(spark.createDataFrame(data, "file string, turn_no bigint, speaker string, start double, end double"))
    assert rows(T.cleaned(t), "utt_id") == [("audio-1.2_7_1",), ("audio-1.2_operateur_2",)]  # exactly 2 s is dropped
    assert rows(T.cleaned(t, renumber=True), "utt_id") == [("audio-1.2_7_1",), ("audio-1.2_operateur_1",)]
    assert rows(T.valid_calls(t)) == [("audio-1.2", 3)]
    assert ("audio-1.2", "locuteur_7", 1, 9000, 12500, "audio-1.2_locuteur_7_1.wav") in rows(T.cut_list(t))
    assert rows(T.duration_lists(t), "speaker", "durations") == [("7", "3.50"), ("operateur", "1.00;4.00;2.00")]
    assert rows(T.speakers_of(t)) == [("audio-1.2", "7,operateur")]
