"""Diarisation-table queries over ``turns`` (and ``utterance_vectors`` for the embedding filter)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parolis.operators import turns as T
from parolis.operators.encoding import speaker_type
from parolis.runtime import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.valid_turns(table(spark, sf_dir, "turns"))


def turn_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_ordinals(_turns(spark, sf_dir)).select("audio_id", "speaker", "turn_no", "start", "end", "ordinal", "utt_id")


def turn_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cleaned(_turns(spark, sf_dir)).select("utt_id", "duration")


def turn_filter_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cleaned(_turns(spark, sf_dir), renumber=True).select("utt_id", "duration")


def embedding_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns long enough for an embedding, at least one second."""
    return T.with_ordinals(_turns(spark, sf_dir)).where(F.col("duration") >= T.EMBED_SECONDS).select("utt_id", "duration")


def embedding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with a vector whose turn survives cleaning."""
    kept = T.cleaned(_turns(spark, sf_dir)).select("utt_id")
    have = table(spark, sf_dir, "utterance_vectors").where("utt_id IS NOT NULL AND v IS NOT NULL").select("utt_id").distinct()
    return have.join(kept, "utt_id", "left_semi")


def valid_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.valid_calls(_turns(spark, sf_dir))


def talk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.talk_time(_turns(spark, sf_dir)).withColumn("seconds", F.round("seconds", 3))


def duration_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    parts = F.array_sort(F.collect_list(F.struct("turn_no", "start", "end", F.round(F.col("duration") * 1000).cast("bigint").cast("string").alias("d"))))
    return t.groupBy("audio_id", "speaker").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(parts, lambda x: x["d"]), ";").alias("durations_ms"))


def speaker_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).select("speaker").distinct()
    return t.select("speaker", T.named(F.col("speaker")).alias("speaker_name"))


def cut_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cut_list(_turns(spark, sf_dir))


def call_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.speakers_of(_turns(spark, sf_dir))


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns").where("file IS NOT NULL")
    return t.groupBy(T.call_id(F.col("file")).alias("audio_id")).agg(F.count("*").alias("n_rows"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a reference and hypothesis chart: side, track, start, length in seconds."""
    a = table(spark, sf_dir, "annotations").where("audio_id IS NOT NULL AND start IS NOT NULL AND end > start AND tier NOT IN ('Ac_ev', 'bruit')")
    a = a.select("ann_id", "audio_id", "tier", "start", "end").distinct()
    ref = a.select(F.lit("reference").alias("side"), "audio_id", F.col("tier").alias("track"), (F.col("start") / 1000.0).alias("start"), ((F.col("end") - F.col("start")) / 1000.0).alias("length"))
    hyp = _turns(spark, sf_dir).select(F.lit("hypothesis").alias("side"), "audio_id", F.col("speaker").alias("track"), "start", F.col("duration").alias("length"))
    return ref.unionByName(hyp)


def tier_cut_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces to cut by annotation track and value: numbered in order of time, with file names free of blanks."""
    a = table(spark, sf_dir, "annotations").where("audio_id IS NOT NULL AND start IS NOT NULL AND end > start")
    a = a.select("ann_id", "audio_id", "tier", "start", "end", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["ann_id"])
    bucket = F.coalesce(F.nullif(F.lower(F.trim("text")), F.lit("")), F.lit("sans_valeur"))
    a = a.where("tier IN ('Ac_ev', 'bruit')").withColumn("bucket", bucket)
    w = Window.partitionBy("audio_id", "tier", "bucket").orderBy("start", "end", "ann_id")
    a = a.withColumn("seg_no", F.row_number().over(w))
    name = F.concat("audio_id", F.lit("_"), F.translate(F.concat_ws("_", "tier", "bucket"), " /", "__"), F.lit("_"), F.lpad(F.col("seg_no").cast("string"), 3, "0"), F.lit(".wav"))
    return a.select("ann_id", "bucket", "seg_no", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), name.alias("out_name"))


def tier_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations by the kind of speaker that the track name says."""
    a = table(spark, sf_dir, "annotations").where("tier IS NOT NULL")
    return a.groupBy(speaker_type(F.col("tier")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("ann_id").alias("n_distinct"))


QUERIES = {
    "tier_cut_list": tier_cut_list, "tier_types": tier_types,
    "turn_ordinals": turn_ordinals, "turn_filter": turn_filter, "turn_filter_renumbered": turn_filter_renumbered,
    "embedding_turns": embedding_turns, "embedding_filter": embedding_filter, "valid_calls": valid_calls, "talk_time": talk_time,
    "duration_lists": duration_lists, "speaker_mapping": speaker_mapping, "cut_list": cut_list, "call_speakers": call_speakers,
    "file_listing": file_listing, "timeline": timeline,
}

_ID = r"regexp_replace(regexp_replace(trim(file), '^.*[/\\]', ''), '\.wav$', '', 'i')"
TURNS_SQL = rf"""WITH t AS (SELECT *, round("end" - start, 3) AS duration FROM (SELECT DISTINCT {_ID} AS audio_id, turn_no, lower(trim(speaker)) AS speaker,
  round(start, 3) AS start, round("end", 3) AS "end" FROM turns) WHERE audio_id IS NOT NULL AND speaker IS NOT NULL AND start IS NOT NULL AND "end" > start)"""
_ORD = TURNS_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY audio_id, speaker ORDER BY turn_no, start, "end") AS ordinal FROM t),
u AS (SELECT *, audio_id || '_' || speaker || '_' || CAST(ordinal AS VARCHAR) AS utt_id FROM o)"""
ORDINALS_SQL = _ORD
_NAME = "CASE WHEN speaker = 'operateur' THEN 'OP-SDIS1' WHEN speaker IN ('0', '1', '2', '3', '4') THEN 'requerant' || speaker ELSE 'locuteur_' || speaker END"

SQL = {
    "tier_cut_list": """WITH a AS (SELECT ann_id, any_value(audio_id) AS audio_id, any_value(tier) AS tier, any_value(start) AS start_ms, any_value("end") AS end_ms,
  coalesce(any_value(text), '') AS text FROM annotations WHERE audio_id IS NOT NULL AND start IS NOT NULL AND "end" > start GROUP BY ann_id),
b AS (SELECT *, coalesce(nullif(lower(trim(text)), ''), 'sans_valeur') AS bucket FROM a WHERE tier IN ('Ac_ev', 'bruit')),
n AS (SELECT *, row_number() OVER (PARTITION BY audio_id, tier, bucket ORDER BY start_ms, end_ms, ann_id) AS seg_no FROM b)
SELECT ann_id, bucket, seg_no, start_ms, end_ms, audio_id || '_' || translate(tier || '_' || bucket, ' /', '__') || '_' || lpad(CAST(seg_no AS VARCHAR), 3, '0') || '.wav' AS out_name FROM n""",
    "tier_types": """SELECT CASE WHEN contains(tier, 'Requerant') THEN 'Requerant' WHEN contains(tier, 'OP-SDIS1') THEN 'OP-SDIS1'
  WHEN contains(tier, 'Intervenant') THEN 'Intervenant' ELSE 'autre' END AS kind, count(*) AS n, count(DISTINCT ann_id) AS n_distinct FROM annotations WHERE tier IS NOT NULL GROUP BY 1""",
    "turn_ordinals": _ORD + 'SELECT audio_id, speaker, turn_no, start, "end", ordinal, utt_id FROM u',
    "turn_filter": _ORD + "SELECT utt_id, duration FROM u WHERE duration > 2.0",
    "turn_filter_renumbered": _ORD.replace("FROM t)", "FROM t WHERE duration > 2.0)") + "SELECT utt_id, duration FROM u",
    "embedding_turns": _ORD + "SELECT utt_id, duration FROM u WHERE duration >= 1.0",
    "embedding_filter": _ORD + "SELECT DISTINCT utt_id FROM utterance_vectors WHERE v IS NOT NULL AND utt_id IN (SELECT utt_id FROM u WHERE duration > 2.0)",
    "valid_calls": TURNS_SQL + "SELECT audio_id, count(*) AS n_turns FROM t WHERE speaker = 'operateur' GROUP BY audio_id HAVING count(*) > 1",
    "talk_time": TURNS_SQL + "SELECT audio_id, speaker, count(*) AS n_turns, round(sum(duration), 3) AS seconds FROM t GROUP BY audio_id, speaker",
    "duration_lists": TURNS_SQL + """SELECT audio_id, speaker, count(*) AS n_turns,
  string_agg(CAST(CAST(round(duration * 1000) AS BIGINT) AS VARCHAR), ';' ORDER BY turn_no, start, "end") AS durations_ms FROM t GROUP BY audio_id, speaker""",
    "speaker_mapping": TURNS_SQL + f"SELECT DISTINCT speaker, {_NAME} AS speaker_name FROM t",
    "cut_list": TURNS_SQL + f""", n AS (SELECT *, {_NAME} AS speaker_name FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY audio_id, speaker_name ORDER BY turn_no, start, "end") AS seg_no FROM n)
SELECT audio_id, speaker_name, seg_no, CAST(floor(round(start * 1000, 3)) AS BIGINT) AS start_ms, CAST(floor(round("end" * 1000, 3)) AS BIGINT) AS end_ms,
  audio_id || '_' || translate(speaker_name, ' /', '__') || '_' || CAST(seg_no AS VARCHAR) || '.wav' AS out_name FROM k""",
    "call_speakers": TURNS_SQL + "SELECT audio_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM t GROUP BY audio_id",
    "file_listing": f"SELECT {_ID} AS audio_id, count(*) AS n_rows FROM turns WHERE file IS NOT NULL GROUP BY 1",
    "timeline": TURNS_SQL + """SELECT 'reference' AS side, audio_id, tier AS track, start / 1000.0 AS start, ("end" - start) / 1000.0 AS length
FROM (SELECT DISTINCT ann_id, audio_id, tier, start, "end" FROM annotations WHERE audio_id IS NOT NULL AND start IS NOT NULL AND "end" > start AND tier NOT IN ('Ac_ev', 'bruit'))
UNION ALL SELECT 'hypothesis', audio_id, speaker, start, duration FROM t""",
}
