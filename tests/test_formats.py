import json
import struct
import wave

import numpy as np
import pytest
from conftest import rows

from parolis.operators import profiles
from parolis.sinks import writers
from parolis.sources import embedding_stream as S
from parolis.sources import readers as R
from parolis.streaming.talk_time import talk_time


def test_diarisation_and_asr_json(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"files": [{"file": "a.wav", "turns": [{"speaker": 1, "start": 0.0, "end": 1.5}, {"speaker": "operateur", "start": 2, "end": 3}]}, {"file": "b.wav", "turns": []}]}))
    assert rows(R.diarisation_json(spark, str(tmp_path / "t.json"))) == [("a.wav", 1, "1", 0.0, 1.5), ("a.wav", 2, "operateur", 2.0, 3.0)]
    assert R.turns_of_file(spark, str(tmp_path / "t.json"), "zz.wav").count() == 0
    assert rows(R.file_names(spark, str(tmp_path / "t.json"))) == [("a.wav",), ("b.wav",)]
    (tmp_path / "w.json").write_text(json.dumps({"segments": [{"words": [{"word": "un", "start": 2.0, "end": 3.0}, {"word": "zéro"}]}, {"text": "x"}]}))
    words = R.asr_words(spark, str(tmp_path / "w.json"))
    assert rows(R.asr_full_text(words), "text") == [("zéro un",)]
    assert R.asr_words(spark, str(tmp_path / "w.json"), missing_first=False).count() == 1


EAF = """<?xml version="1.0"?><ANNOTATION_DOCUMENT><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="ts1" TIME_VALUE="0"/><TIME_SLOT TIME_SLOT_ID="ts2" TIME_VALUE="1500"/></TIME_ORDER>
<TIER TIER_ID="OP"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a1" TIME_SLOT_REF1="ts1" TIME_SLOT_REF2="ts2"><ANNOTATION_VALUE> Allo </ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>
<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a2" TIME_SLOT_REF1="ts1" TIME_SLOT_REF2="ts9"><ANNOTATION_VALUE>x</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER>
<TIER TIER_ID="Ac_ev"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a3" TIME_SLOT_REF1="ts1" TIME_SLOT_REF2="ts2"><ANNOTATION_VALUE></ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER></ANNOTATION_DOCUMENT>"""


def test_eaf(spark, tmp_path):
    (tmp_path / "c.eaf").write_text(EAF)
    got = rows(R.eaf_annotations(spark, str(tmp_path / "c.eaf")), "tier", "start", "end", "bucket")
    assert got == [("Ac_ev", 0, 1500, "sans_valeur"), ("OP", 0, 1500, "allo")]
    assert R.eaf_annotations(spark, str(tmp_path / "c.eaf"), ignore=("Ac_ev",)).count() == 1
    assert [r.tier for r in R.eaf_tiers(spark, str(tmp_path / "c.eaf")).collect()] == ["Ac_ev", "OP"]


def test_text_formats(spark, tmp_path):
    (tmp_path / "e.txt").write_text("OP\tx\t0\t1\tallo\n\nbad line\n")
    good, bad = R.elan_export(spark, str(tmp_path / "e.txt"))
    assert rows(good) == [("OP", "x", "0", "1", "allo")] and rows(bad) == [("bad line",)]
    writers.audacity_labels(good, str(tmp_path / "labels"))
    assert next((tmp_path / "labels" / "speaker=OP").glob("*.csv")).read_text() == "0\t1\tOP\n"
    (tmp_path / "v.csv").write_text("a|1 2\n\nnopipe\nb|1 x\nc|\na|3 4\n")
    assert rows(R.embedding_text(spark, str(tmp_path / "v.csv"))) == [("a", [3.0, 4.0])]
    (tmp_path / "s.txt").write_text("a 1 2\nb 3 x\n")
    with pytest.raises(Exception, match="malformed"):
        R.embedding_text_strict(spark, str(tmp_path / "s.txt")).collect()
    (tmp_path / "g.csv").write_text("nom_commune\n Saint-Jean \nsaint jean\n\n")
    assert rows(R.gazetteer(spark, str(tmp_path / "g.csv"))) == [("saint jean",)]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"nom_commune": "Été-Bas"}}, {"properties": {}}]}))
    assert rows(R.gazetteer(spark, str(tmp_path / "g.json"))) == [("été bas",)]
    (tmp_path / "r.jsonl").write_text('{"label": "L", "pattern": [{"LOWER": "feu"}]}\n')
    assert R.token_rules(spark, str(tmp_path / "r.jsonl"))[0].category == "L"
    (tmp_path / "c.csv").write_text("/home\n\naudio-1.2_operateur_10.wav x\naudio-1.2_operateur_2.wav\nother.wav\n")
    assert rows(R.segment_catalogue(spark, str(tmp_path / "c.csv")), "discussion", "ordinal") == [("audio-1.2", 10), ("audio-1.2", 2)]
    (tmp_path / "w.txt").write_text("a.wav\n\n")
    assert rows(R.worklist(spark, str(tmp_path / "w.txt"))) == [("a.wav",)]
    vectors = spark.createDataFrame([("a_1", [1.0]), ("ba_1", [2.0])], "utt_id string, v array<double>")
    assert rows(R.find_vector(vectors, "a_1")) == [("a_1", [1.0])] and rows(R.find_vector(vectors, "ba", False)) == [("ba_1", [2.0])]


def test_cluster_documents_round_trip(spark, tmp_path):
    for folder, members in (("a", ["x"]), ("b", ["y", "z"])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "cluster_locuteur_r.json").write_text(json.dumps({"reference_utilisee": "r", "seuil_intra_applique": 0.5, "nombre_membres": 1, "membres_cluster": members}))
    assert rows(R.cluster_documents(spark, str(tmp_path)), "ref", "target") == [("r", "y"), ("r", "z")]
    c = spark.createDataFrame([("r", 0.5, 2, "y,z"), ("q", 0.1, 0, "")], "ref string, threshold double, n_members bigint, members string")
    writers.cluster_json(c, str(tmp_path / "out"))
    assert json.loads(next((tmp_path / "out" / "ref=r").glob("*.json")).read_text())["membres_cluster"] == ["y", "z"]


def test_binary_embeddings(spark, tmp_path):
    data = S.header() + S.record("a", [1, 2]) + S.header() + S.record("é", [0.5], b"d") + S.record("h", [1.5], b"h")
    assert [(u, v.tolist()) for u, v in S.parse_binary(data)] == [("a", [1.0, 2.0]), ("é", [0.5]), ("h", [1.5])]
    for bad in (b"NOTMAGIC", S.header()[:-1], S.MAGIC + struct.pack("<I", 2), data[:-1], S.header() + struct.pack("<I", 1) + b"aq" + struct.pack("<I", 1), S.header() + struct.pack("<I", 1) + b"af" + struct.pack("<I", 0)):
        with pytest.raises(S.EmbeddingFormatError):
            list(S.parse_binary(bad))
    (tmp_path / "e.spk").write_bytes(data)
    S.register(spark)
    assert rows(spark.read.format("speaker_embeddings").load(str(tmp_path / "e.spk")).select("utt_id")) == [("a",), ("h",), ("é",)]
    df = spark.createDataFrame([("u1", [1.0, 0.25]), ("u2", [3.0])], "utt_id string, v array<double>")
    for kind in ("binary", "text"):
        df.write.format("speaker_embeddings").option("kind", kind).mode("overwrite").save(str(tmp_path / kind))
        assert rows(spark.read.format("speaker_embeddings").option("kind", kind).load(str(tmp_path / kind))) == rows(df)
    assert S.parse_spec("pkl,t:/x") == (False, "/x") and S.parse_spec("pkl:/x") == (True, "/x")
    for bad in ("pkl:-", "pkl:cat x |", "abc:/x", "pkl"):
        with pytest.raises(ValueError):
            S.parse_spec(bad)


def test_wav_and_numpy_files(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[16384, 0]] * 80, dtype="<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    got = R.wav_samples(spark, str(tmp_path)).collect()
    assert len(got) == 1 and len(got[0].samples) == 160 and got[0].samples[10] == pytest.approx(0.25)
    np.save(tmp_path / "v.npy", np.ones((1, 3)))
    assert [r.v for r in R.numpy_vectors(spark, str(tmp_path), "v.").collect()] == [[1.0, 1.0, 1.0]]


def test_reports(spark, tmp_path):
    data = [("a", i, [1.0, float(i)], 1.0) for i in range(5)] + [("b", 9, [1.0, 0.5], 1.0)]
    s = spark.createDataFrame(data, "discussion string, utt_id bigint, v array<double>, duration double")
    top = profiles.top_by_centroid(s, 3)
    prof = profiles.profiles(s, top)
    intra = profiles.intra(s, top, prof)
    thresholds = intra.selectExpr("discussion AS ref", "mean_sim AS threshold")
    report = writers.similarity_report(intra, profiles.all_pairs(prof), "a", thresholds).selectExpr("'now' AS run", "'operateur' AS speaker", "*")
    writers.similarity_csv(report, str(tmp_path / "r"), writers.TOP_K_CLUSTER)
    lines = next((tmp_path / "r").glob("*.csv")).read_text().splitlines()
    assert lines[0].startswith("Date Exécution;Locuteur Cible;Type Analyse") and ";INTRA;a;5;" in lines[1] and lines[1].endswith("RÉFÉRENCE") and "N/A" in lines[2]
    out = spark.createDataFrame([("c", "X", "feu", "CORRECT", "feu", 1.0)], "audio_id string, category string, mot string, status string, perceived string, score double")
    from parolis.operators.entities import concept_error_rates

    writers.evaluation_json(out, concept_error_rates(out), str(tmp_path / "ev"))
    doc = json.loads(next((tmp_path / "ev").glob("*.json")).read_text())
    assert doc["statistiques"]["n_correct"] == 1 and doc["details"]["correct"][0]["mot"] == "feu"


def test_streaming_talk_time(spark, tmp_path):
    schema = "file string, speaker string, start double, end double, loaded_at timestamp"
    df = spark.sql("SELECT 'a.wav' AS file, ' OP' AS speaker, 0D AS start, 2D AS end, timestamp'2024-01-01 10:00:00' AS loaded_at UNION ALL SELECT 'a.wav', 'op', 3D, 4D, timestamp'2024-01-01 11:00:00' UNION ALL SELECT NULL, 'op', 3D, 4D, timestamp'2024-01-01 11:00:00'")
    df.write.parquet(str(tmp_path / "in"))
    q = talk_time(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("talk").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT audio_id, speaker, n_turns, seconds FROM talk").collect()] == [("a", "op", 2, 3.0)]
    assert rows(talk_time(df), "audio_id", "speaker", "n_turns", "seconds") == [("a", "op", 2, 3.0)]
