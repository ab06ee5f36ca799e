import json

import pytest
from conftest import rows

from parolis.functions import audio
from parolis.operators import entities as E
from parolis.operators import scoring
from parolis.operators import turns as T
from parolis.sinks import writers
from parolis.sources import readers
from pyspark.sql import functions as F


def texts(spark, data):
    return spark.createDataFrame(data, "audio_id string, text_id int, text string")


def lines(path, pattern="*"):
    return [x for p in sorted(path.glob(f"**/part-{pattern}")) for x in p.read_text().splitlines()]


def test_a_concept_is_perceived_as_it_is_written(spark):
    ref = texts(spark, [("c", 1, "odeur de gaz, fumée et pharmacie")])
    asr = texts(spark, [("c", 2, "Une ODEUR de gaz, la Fumée monte"), ("c", 1, "rien")])
    got = {r.mot: r.perceived for r in E.outcomes(ref, asr).collect()}
    assert got["odeur de gaz"] == "ODEUR de gaz" and got["fumee"] == "Fumée" and got["pharmacie"] is None


def test_a_recognised_span_goes_before_single_words(spark):
    ref = texts(spark, [("c", 1, "la pharmacie fume")])
    asr = texts(spark, [("c", 1, "pharmacye fumes")])
    spans = spark.createDataFrame([("c", 1, "Pharmacies", 9), ("c", 1, "Farmacie", 3), ("c", 2, "pharmacie", 0), ("d", 0, "pharmacie", 0)], "audio_id string, text_id int, mot string, start int")
    got = {r.mot: (r.status, r.perceived) for r in E.outcomes(ref, asr, recognised=spans).collect()}
    assert got["pharmacie"] == ("SUBSTITUTION", "Farmacie") and got["fume"][0] == "CORRECT"
    plain = {r.mot: r.perceived for r in E.outcomes(ref, asr).collect()}
    assert plain["pharmacie"] == "pharmacye"


def test_roots_flags_and_spans(spark):
    out = spark.createDataFrame(
        [("c", "LIEU_AUTO_LOC", "a", "CORRECT", "ner"), ("c", "LIEU", "b", "CORRECT", "rules"), ("c", "LIEU", "d", "DELETION", "rules"), ("d", "FEU", "e", "DELETION", "rules")],
        "audio_id string, category string, mot string, status string, source string",
    )
    got = {r.root: (r.n, r.n_correct, r.rate, r.by_source) for r in E.performance_by_root(out).collect()}
    assert got == {"LIEU": (3, 2, pytest.approx(66.666667), {"ner": 1, "rules": 1}), "FEU": (1, 0, 0.0, {})}
    found = spark.createDataFrame([("c", "X", "b"), ("d", "X", "b"), ("c", "X", "d")], "audio_id string, category string, mot string")
    assert rows(E.perceived(found, out), "audio_id", "mot", "percu") == [("c", "b", True), ("c", "d", False), ("d", "b", False)]
    spans = spark.createDataFrame([("c", 1, "X", 3, "b", 0, 4), ("c", 1, "X", 2, "b", 0, 4), ("c", 1, "Y", 1, "b", 0, 4)], "audio_id string, text_id int, category string, rule_no int, mot string, start int, end int")
    assert rows(E.distinct_spans(spans), "category", "rule_no") == [("X", 2), ("Y", 1)]
    assert E.distinct_spans(spans.limit(0)).count() == 0 and E.performance_by_root(out.limit(0)).count() == 0


def test_entity_list_and_evaluation(spark, tmp_path):
    found = spark.createDataFrame([("c", "feu", "X", "op", 4.5, 5.0, "rules"), ("c", "gaz", "X", None, 1.234, 2.0, "ner")], "audio_id string, mot string, category string, speaker string, start_s double, end_s double, source string")
    writers.entity_list(found, str(tmp_path / "list"))
    got = [json.loads(x) for x in lines(tmp_path / "list")]
    assert [x["mot"] for x in got] == ["gaz", "feu"] and got[0]["debut_sec"] == 1.23 and got[1]["locuteur"] == "op" and got[0]["source_detection"] == "ner"
    out = spark.createDataFrame([("c", "X", "feu", "CORRECT", "Feu", 1.0), ("d", "X", "gaz", "DELETION", None, 0.0)], "audio_id string, category string, mot string, status string, perceived string, score double")
    added = spark.createDataFrame([("c", "zut"), ("c", "encore"), ("c", "zut")], "audio_id string, word string")
    writers.evaluation_json(out, E.concept_error_rates(out), str(tmp_path / "eval"), added)
    got = {x["audio_id"]: x for x in map(json.loads, lines(tmp_path / "eval"))}
    assert got["c"]["details"]["insertions"] == ["encore", "zut"] and got["d"]["details"]["insertions"] == [] and got["c"]["fichier_source"] == "c.wav"
    assert got["c"]["details"]["correct"][0]["perceived"] == "Feu" and got["d"]["statistiques"]["n_deleted"] == 1


def test_classification_files(spark, tmp_path):
    decided = spark.createDataFrame([("u2", "c", "op", 0.25, False), ("u1", "c", "op", 0.75, True)], "utt_id string, discussion string, kind string, score double, same_speaker boolean")
    writers.classification_csv(decided, str(tmp_path / "csv"))
    got = lines(tmp_path / "csv")
    assert got[0] == "Fichier,Discussion,Type,Score,Decision" and got[1:] == ["u1,c,op,0.75,MÊME LOCUTEUR", "u2,c,op,0.25,LOCUTEUR DIFFÉRENT"]
    stats = scoring.decision_stats(decided).where("discussion IS NULL")
    writers.classification_report(stats, str(tmp_path / "txt"))
    assert [x.split() for x in lines(tmp_path / "txt")] == [["op", "2", "1", "1", "50.0%"], ["TOTAL", "2", "1", "1", "50.0%"]]


def test_boxes_bonus_and_selections(spark, tmp_path):
    s = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0, None)] + [("b", 5.0)], "kind string, score double")
    assert rows(scoring.five_numbers(s)) == [("a", 4, 1.0, 1.75, 2.5, 3.25, 4.0), ("b", 1, 5.0, 5.0, 5.0, 5.0, 5.0)]
    q = spark.createDataFrame([("x", 3.5), ("x complet", 3.5), ("complet", 90.0)], "name string, d double")
    good = q.select("name", audio.quality_of(F.col("d"), F.lit(30.0), F.lit(1.0), F.lit(1.0), F.col("name")).alias("q"))
    v = {r["name"]: r.q for r in good.collect()}
    assert v["x complet"] == min(1.0, v["x"] * 1.1) and v["x"] < v["x complet"] <= 1.0
    low = q.where("name = 'complet'").select(audio.quality_of(F.col("d"), F.lit(-90.0), F.lit(0.0), F.lit(0.0), F.col("name"))).first()[0]
    assert low < 0.3
    t = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "audio_id string")
    assert [tuple(r) for r in T.by_count(t).collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert rows(T.restricted(t, "audio_id", ["b", "z"])) == [("b",), ("b",)] and T.restricted(t, "audio_id", []).count() == 4 == T.restricted(t, "audio_id", None).count()
    names = spark.createDataFrame([("0042_x.wav",), ("x12",), (None,)], "n string")
    assert [r[0] for r in names.select(T.discussion_number(F.col("n"))).collect()] == ["0042", "unknown", "unknown"]
    (tmp_path / "work.txt").write_text("a.wav\n\nb_ameliore.wav\n c.wav \n")
    assert rows(readers.worklist(spark, str(tmp_path / "work.txt"))) == [("a.wav",), ("c.wav",)]
