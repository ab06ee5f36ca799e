import difflib
import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st

from parolis.functions import audio, rules
from parolis.functions import text as T
from parolis.operators import entities as E
from pyspark.sql import functions as F


def brute_edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], min(p + (x != y), d[j] + 1, d[j + 1] + 1)
    return d[-1]


@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_edits(a, b):
    assert T.edits(a, b) == brute_edits(a, b)


@given(st.text(max_size=30), st.text(max_size=30))
def test_ratio(a, b):
    assert T.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio() and 0 <= T.ratio(a, b) <= 1


def test_normalisation(spark):
    data = [("Bon ben, ÉTÉ à l'Œuvre... euh [bruit] !",), ("e\u0301te\u0301 hein",), (None,), ("",)]
    df = spark.createDataFrame(data, "t string")
    got = [tuple(r) for r in df.select(T.normalize_detect(F.col("t")), T.normalize_display(F.col("t"))).collect()]
    assert got == [("ete a l œuvre bruit", "bon ben été à l œuvre euh bruit"), ("ete", "e\u0301te\u0301 hein"), (None, None), ("", "")]


def test_clean_annotation_and_elision(spark):
    data = [("(bruit)",), (" und ",), ("Le [BRUIT]  feu und",), ("",), ("place d",)]
    df = spark.createDataFrame(data, "t string")
    assert [r[0] for r in df.select(T.clean_annotation(F.col("t"))).collect()] == [None, None, "Le feu", None, "place d"]
    assert [r[0] for r in df.select(T.trim_elided(F.col("t"))).collect()][-1] == "place"


def test_token_patterns():
    p = rules.compile_tokens([{"LOWER": "ne"}, {"LOWER": "me", "OP": "?"}, {"LOWER": {"REGEX": "^r[eé]pond(s|ent)?$"}}, {"LOWER": {"IN": ["pas", "plus"]}}])
    import re

    assert re.search(p, "il ne repond pas") and re.search(p, "ne me reponds plus") and not re.search(p, "ne repondra pas")
    plus = rules.compile_tokens([{"LOWER": "tres", "OP": "+"}, {"TEXT": "mal"}])
    assert re.search(plus, "va tres tres mal la").group().strip() == "tres tres mal"
    assert re.search(rules.compile_tokens([{"LOWER": "tout", "OP": "?"}, {"LOWER": "feu"}]), "au feu")


def test_spans_have_offsets_of_the_text():
    t = "Il a Perdu connaissance, une fumée noire"
    got = rules.find_spans("Elle est inconscient, odeur de gaz", rules.RULES)
    assert {(g["mot"], g["start"]) for g in got} == {("inconscient", 9), ("odeur de gaz", 22)}
    assert [t[g["start"] : g["end"]] for g in rules.find_spans(t)] == ["a Perdu connaissance", "fumée"]
    assert rules.find_spans("") == rules.find_spans(None) == []


def test_outcomes_rates_and_insertions(spark):
    ref = spark.createDataFrame([("c", 1, "une odeur de gaz"), ("c", 2, "il vomit et tremble"), ("d", 3, "la mairie")], "audio_id string, text_id int, text string")
    asr = spark.createDataFrame([("c", 1, "Odeur de gaz"), ("c", 2, "il vomi encore beaucoup"), ("e", 9, "feu")], "audio_id string, text_id int, text string")
    out = E.outcomes(ref, asr)
    got = {(r.audio_id, r.mot): (r.status, r.perceived) for r in out.collect()}
    assert got == {("c", "odeur de gaz"): ("CORRECT", "Odeur de gaz"), ("c", "vomit"): ("SUBSTITUTION", "vomi"), ("c", "tremble"): ("DELETION", None), ("d", "mairie"): ("DELETION", None)}
    rates = {r.audio_id: r for r in E.concept_error_rates(out).collect()}
    assert rates["c"].n == 3 and rates["c"].wer == pytest.approx(2 / 3) and rates["c"].precision == pytest.approx(100 / 3)
    assert rows(E.insertions(ref, asr)) == [("c", "beaucoup"), ("c", "encore")]


def test_gazetteer(spark):
    texts = spark.createDataFrame([(1, "à Saint-Jean des Prés, puis Été"), (2, "rien"), (3, None)], "text_id int, text string")
    places = spark.createDataFrame([("saint jean des",), ("ete",), ("",)], "place string")
    assert rows(E.gazetteer_matches(texts, places)) == [(1, "ete", 1), (1, "saint jean des", 1)]
    assert E.gazetteer_matches(texts, places.limit(0)).count() == 0


def test_gazetteer_names_of_any_length(spark):
    texts = spark.createDataFrame([(1, "vers Saint-Orens-de-Gameville, non, L'Isle-en-Dodon"), (2, "Saint Orens de"), (3, None)], "text_id int, text string")
    places = spark.createDataFrame([("saint orens de gameville",), ("l'isle en dodon",), ("a b c d e f g",)], "place string")
    assert rows(E.gazetteer_matches(texts, places)) == [(1, "l isle en dodon", 1), (1, "saint orens de gameville", 1)]


def test_context(spark):
    texts = spark.createDataFrame([(1, "la fumée sort du hangar par le vieux portail"), (2, "il brule"), (3, "fumée du hangar, vapeur du lavoir")], "text_id int, text string")
    found = E.entities(texts.select(F.lit("c").alias("audio_id"), "text_id", "text"))
    words = [("atelier", "hangar", 2.0), ("atelier", "portail", 2.0), ("lavoir", "vapeur", 1.5), ("atelier", "vapeur", -3.0), ("lavoir", "hangar", -1.0), ("lavoir", "lavoir", 1.5), (None, "x", 1.0), ("lavoir", None, 1.0), ("lavoir", "portail", None)]
    contexts = spark.createDataFrame(words, "context string, word string, weight double")
    doubts = (("fum", ("lavoir",), ("atelier",)), ("brule", (), ("atelier", "lavoir")))
    got = {(r.text_id, r.mot): r for r in E.context_scores(found, texts, contexts, doubts=doubts).collect()}
    assert got[1, "fumee"].context == "atelier" and got[1, "fumee"].context_score == 4.0 and got[1, "fumee"].confidence == pytest.approx(0.8)
    assert got[2, "brule"].context is None and got[2, "brule"].false_positive and not got[1, "fumee"].false_positive
    assert got[3, "fumee"].context == "lavoir" and got[3, "fumee"].context_score == 2.0 and got[3, "fumee"].false_positive
    loose = {(r.text_id, r.mot): r for r in E.context_scores(found, texts, contexts, strict=False).collect()}
    # pairs: sort+hangar, hangar+vieux, vieux+portail hold a word each, portail ends the text
    assert loose[1, "fumee"].context_score == 4.0 + 3 * 1.0 and not loose[2, "brule"].false_positive
    none = E.context_scores(found, texts, contexts.limit(0)).collect()
    assert len(none) == len(got) and {r.context for r in none} == {None}


def test_word_error_rates(spark):
    df = spark.createDataFrame([("c", "le feu brûle", "le feu"), ("c", "euh", "x"), ("c", "un chat", None)], "audio_id string, ref string, hyp string")
    r = E.segment_error_rates(df).first()
    assert (r.n_segments, r.n_words) == (2, 5) and r.macro_wer == pytest.approx((1 / 3 + 1) / 2) and r.micro_wer == pytest.approx(3 / 5)


def test_audio_measures():
    fs = 16_000
    t = np.arange(fs) / fs
    tone = np.where((t > 0.3) & (t < 0.7), np.sin(2 * np.pi * 440 * t), 0.001 * np.sin(2 * np.pi * 900 * t))
    assert 50 < audio.gate_snr(tone, fs) < 70 and 0.3 < audio.speech_frames(tone, fs).mean() < 0.5
    assert audio.gate_snr(tone[:100], fs) == 50.0 and audio.quality_snr(tone[:100], fs) == 0.0
    hum = 0.5 + np.sin(2 * np.pi * 440 * t)
    b, a = audio.butter_highpass(4, 80 / (fs / 2))
    y = audio.zero_phase(b, a, hum)
    assert abs(y[2000:-2000].mean()) < 1e-3 and np.allclose(y[4000:-4000], hum[4000:-4000] - 0.5, atol=2e-2)
    assert audio.zero_phase(b, a, hum[:10]) is not None and len(audio.preprocess(hum[:10], fs)) == 10
    assert audio.stability(np.ones((1, 4))) == (1.0, 0.0)
    assert audio.windows(4 * fs, fs, np.ones(400, bool)) == [(0, 3 * fs), (fs, 4 * fs)]
    speech = np.zeros(900, bool)
    speech[500:850] = True
    assert 400 <= audio.densest_zone(speech, fs) <= 600


def test_frame_energies_match_the_definition():
    x = np.array([random.Random(1).gauss(0, 1) for _ in range(300)])
    w, h = 10, 4
    assert np.allclose(audio.frame_energies(x, 400), [np.sum(x[i : i + w] ** 2) for i in range(0, len(x) - w, h)])
