import numpy as np
import pytest
from conftest import rows

from parolis.operators import encoding as E
from parolis.operators import ner as N
from pyspark.sql import functions as F


def test_recogniser_routing_and_merge(spark):
    def recogniser():
        return lambda texts: [[(w, t.index(w), t.index(w) + len(w), "LOC")] if (w := "Toulouse") in t else [("deux km", 0, 7, "CARDINAL"), ("il", 0, 2, "PER")] for t in texts]

    texts = spark.createDataFrame([("c", 1, "à Toulouse"), ("c", 2, "deux km"), ("c", 3, None)], "audio_id string, text_id int, text string")
    assert N.recognised(texts, None).count() == 0
    got = N.recognised(texts, recogniser)
    assert rows(got, "text_id", "category", "mot", "start") == [(1, "LIEU_AUTO_LOC", "Toulouse", 2)]
    rules = spark.createDataFrame([("c", 5, "VILLE", "toulouse", 0, 8), ("c", 6, "VILLE", "toulouse", 3, 11)], "audio_id string, text_id int, category string, mot string, start int, end int")
    assert rows(N.merged(rules, got), "category", "mot", "source", "text_id") == [("VILLE", "toulouse", "rules", 5)]
    assert rows(N.merged(rules.limit(0), got), "category", "source") == [("LIEU_AUTO_LOC", "ner")]
    flags = spark.createDataFrame([("place tant que",), ("rue",)], "m string").select(N.false_place(F.col("m")))
    assert [r[0] for r in flags.collect()] == [True, False]


def model():
    return lambda x: np.array([x.mean(), np.abs(x).mean(), len(x) / 16_000, 1.0])


@pytest.mark.parametrize("mode", E.MODES)
def test_modes_give_unit_vectors(mode):
    x = np.sin(np.arange(16_000 * 4) / 7)
    assert np.linalg.norm(E.encode(x, 16_000, model(), mode)) == pytest.approx(1)
    assert np.linalg.norm(E.encode(x[:50], 16_000, model(), mode)) == pytest.approx(1)


def test_segment_vectors_and_stability(spark):
    def model():  # not by reference: the workers do not import this module
        return lambda x: np.array([x.mean(), np.abs(x).mean(), len(x) / 16_000, 1.0])

    x = np.sin(np.arange(16_000 * 4) / 7).tolist()
    recordings = spark.createDataFrame([("a", x)], "file string, samples array<double>")
    cuts = spark.createDataFrame([("a", "u1", 0.0, 2.0), ("a", "u2", 0.0, 0.5), ("b", "u3", 0.0, 2.0)], "file string, utt_id string, start double, end double")
    assert rows(E.segment_vectors(recordings, cuts, model).select("utt_id")) == [("u1",)]
    s = E.window_stability(recordings, model).first()
    assert s.n_windows == 2 and s.mean_sim == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValueError):
        E.encode(np.ones(10), 10, model(), "other")


def test_decisions(spark):
    df = spark.createDataFrame([(25.0, 1.0, None), (10.0, 1.0, None), (10.0, 1.0, 0.5), (10.0, 1.0, 1.0)], "snr double, raw double, clean double")
    assert [r[0] for r in df.select(E.gate_decision(F.col("snr"), F.col("raw"), F.col("clean"))).collect()] == ["clean", "error", "improved", "degraded"]
    ok = spark.createDataFrame([(1.0, 0.1, 0.1), (0.9, 0.1, 0.1)], "d double, s double, q double").select(E.validity(F.col("d"), F.col("s"), F.col("q")))
    assert [r[0] for r in ok.collect()] == [True, False]
