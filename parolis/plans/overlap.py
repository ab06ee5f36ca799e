"""Interval joins between annotations, turns and words: attribution, windows, diarisation error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parolis.operators import overlap as O
from parolis.operators import turns as T
from parolis.runtime import table

MARGIN = 3.0


def annotations_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with call and times, once an id: ``audio_id, entity_id, tier, s, e, text``."""
    a = table(spark, sf_dir, "annotations").where("audio_id IS NOT NULL AND start IS NOT NULL AND end > start")
    a = a.select("ann_id", "audio_id", "tier", "start", "end", "text").dropDuplicates(["ann_id"])
    return a.select("audio_id", F.col("ann_id").alias("entity_id"), "tier", (F.col("start") / 1000.0).alias("s"), (F.col("end") / 1000.0).alias("e"), "text")


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with both times, of each segment once: ``audio_id, rs, re, word, word_no``."""
    g = table(spark, sf_dir, "segments").where("audio_id IS NOT NULL AND words IS NOT NULL").select("seg_id", "audio_id", "words").dropDuplicates(["seg_id"])
    w = g.select("seg_id", "audio_id", F.posexplode("words").alias("pos", "w"))
    w = w.where("w.word IS NOT NULL AND w.start IS NOT NULL AND w.end IS NOT NULL")
    return w.select("audio_id", F.col("w.start").alias("rs"), F.col("w.end").alias("re"), F.col("w.word").alias("word"), (F.col("seg_id") * 10000 + F.col("pos")).alias("word_no"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.valid_turns(table(spark, sf_dir, "turns"))


def overlap_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.attribute_speaker(annotations_once(spark, sf_dir), _turns(spark, sf_dir))


def window_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.words_in_window(annotations_once(spark, sf_dir), timed_words(spark, sf_dir))


def window_alignment_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.words_in_window(annotations_once(spark, sf_dir), timed_words(spark, sf_dir), MARGIN)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ref = annotations_once(spark, sf_dir).where("tier NOT IN ('Ac_ev', 'bruit')")
    ref = ref.select("audio_id", F.col("tier").alias("speaker"), F.col("s").alias("start"), F.col("e").alias("end"))
    return ref, _turns(spark, sf_dir).select("audio_id", "speaker", "start", "end")


def der_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = O.detection_errors(*_sides(spark, sf_dir))
    return x.select("audio_id", *[F.round(c, 6).alias(c) for c in ("total", "missed", "false_alarm")])


def der(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.diarisation_error(*_sides(spark, sf_dir))


def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character offsets of the words of each segment's spoken text, one blank between words."""
    g = table(spark, sf_dir, "segments").where("words IS NOT NULL").select("seg_id", "words").dropDuplicates(["seg_id"])
    texts = F.transform("words", lambda w: F.coalesce(w["word"], F.lit("")))
    x = g.withColumn("t", texts).select("seg_id", "t", F.posexplode("t").alias("pos", "word"))
    start = F.aggregate(F.slice("t", 1, F.col("pos")), F.lit(0), lambda acc, w: acc + F.length(w) + 1)
    return x.select("seg_id", "pos", "word", start.alias("char_start"), (start + F.length("word")).alias("char_end"))


QUERIES = {
    "overlap_attribution": overlap_attribution, "window_alignment": window_alignment, "window_alignment_margin": window_alignment_margin,
    "word_offsets": word_offsets, "der_detection": der_detection, "der": der,
}

from parolis.plans.turns import TURNS_SQL  # noqa: E402

_A = """, a AS (SELECT ann_id AS entity_id, any_value(audio_id) AS audio_id, any_value(tier) AS tier, any_value(start) / 1000.0 AS s, any_value("end") / 1000.0 AS e
  FROM annotations WHERE audio_id IS NOT NULL AND start IS NOT NULL AND "end" > start GROUP BY ann_id)"""
_W = """, g AS (SELECT DISTINCT seg_id, audio_id, words FROM segments WHERE audio_id IS NOT NULL AND words IS NOT NULL),
w AS (SELECT audio_id, words[i].start AS rs, words[i]."end" AS re, words[i].word AS word, seg_id * 10000 + i - 1 AS word_no
      FROM g, unnest(range(1, len(words) + 1)) AS u(i) WHERE words[i].word IS NOT NULL AND words[i].start IS NOT NULL AND words[i]."end" IS NOT NULL)"""


def _window_sql(margin: float) -> str:
    return TURNS_SQL + _A + _W + f"""SELECT a.entity_id, count(w.word) AS n_words, coalesce(string_agg(w.word, ' ' ORDER BY rs, re, word_no), '') AS text
FROM a LEFT JOIN w ON a.audio_id = w.audio_id AND w.rs < a.e + {margin} AND w.re > a.s - {margin} GROUP BY a.entity_id"""


WINDOW_SQL = _window_sql

SQL = {
    "overlap_attribution": TURNS_SQL + _A + """, p AS (SELECT a.entity_id, t.speaker, round(least(a.e, t."end") - greatest(a.s, t.start), 6) AS overlap,
  row_number() OVER (PARTITION BY a.entity_id ORDER BY round(least(a.e, t."end") - greatest(a.s, t.start), 6) DESC, t.start, t."end", t.speaker DESC) AS k
  FROM a JOIN t ON a.audio_id = t.audio_id AND t.start < a.e AND t."end" > a.s)
SELECT a.entity_id, coalesce(p.speaker, 'INCONNU') AS speaker, coalesce(p.overlap, 0.0) AS overlap FROM a LEFT JOIN p ON p.entity_id = a.entity_id AND k = 1""",
    "window_alignment": _window_sql(0.0),
    "window_alignment_margin": _window_sql(MARGIN),
    "word_offsets": """WITH g AS (SELECT DISTINCT seg_id, list_transform(words, lambda w: coalesce(w.word, '')) AS t FROM segments WHERE words IS NOT NULL),
x AS (SELECT seg_id, i - 1 AS pos, t[i] AS word, coalesce(list_sum(list_transform(t[1:i-1], lambda w: length(w) + 1)), 0) AS a FROM g, unnest(range(1, len(t) + 1)) AS u(i))
SELECT seg_id, pos, word, CAST(a AS BIGINT) AS char_start, CAST(a + length(word) AS BIGINT) AS char_end FROM x""",
    "der_detection": TURNS_SQL + _A + """, b AS (SELECT audio_id, tier AS speaker, greatest(s, 0.0) AS s, least(e, 240.0) AS e, 0 AS side FROM a WHERE tier NOT IN ('Ac_ev', 'bruit')
  UNION ALL SELECT audio_id, speaker, greatest(start, 0.0), least("end", 240.0), 1 FROM t),
c AS (SELECT * FROM b WHERE e > s), p AS (SELECT DISTINCT audio_id, x FROM (SELECT audio_id, s AS x FROM c UNION ALL SELECT audio_id, e FROM c)),
i AS (SELECT audio_id, x AS lo, lead(x) OVER (PARTITION BY audio_id ORDER BY x) AS hi FROM p),
n AS (SELECT i.audio_id, hi - lo AS d, count(DISTINCT speaker) FILTER (side = 0) AS r, count(DISTINCT speaker) FILTER (side = 1) AS h
      FROM i JOIN c ON c.audio_id = i.audio_id AND c.s < hi AND c.e > lo WHERE hi IS NOT NULL GROUP BY i.audio_id, lo, hi)
SELECT audio_id, round(sum(d * r), 6) AS total, round(sum(d * greatest(r - h, 0)), 6) AS missed, round(sum(d * greatest(h - r, 0)), 6) AS false_alarm FROM n GROUP BY audio_id""",
}
