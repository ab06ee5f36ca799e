"""Problem 3: the segment nearest to each annotation in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parolis.llm.nearest import nearest_by_time
from parolis.runtime import table, to_ms

TOLERANCE_MS = 750


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "segments").select("seg_id", "audio_id", to_ms(F.col("start")).alias("t"))
    annotations = table(spark, sf_dir, "annotations").select("ann_id", "audio_id", F.col("start").alias("t"))
    pairs = nearest_by_time(annotations, segments, "audio_id", "ann_id", "t", "seg_id", "t", TOLERANCE_MS)
    return pairs.select(F.col("left_id").alias("ann_id"), F.col("right_id").alias("seg_id"))


QUERIES = {"p3_found": p3_found}

SQL = {
    "p3_found": """
WITH a AS (SELECT DISTINCT ann_id, audio_id, start AS t FROM annotations WHERE audio_id IS NOT NULL AND start IS NOT NULL),
s AS (SELECT DISTINCT seg_id, audio_id, CAST(round(start * 1000) AS BIGINT) AS t FROM segments WHERE audio_id IS NOT NULL AND start IS NOT NULL),
c AS (SELECT a.ann_id, s.seg_id, row_number() OVER (PARTITION BY a.ann_id ORDER BY abs(a.t - s.t), s.seg_id) AS k
      FROM a JOIN s ON a.audio_id = s.audio_id AND s.t BETWEEN a.t - 750 AND a.t + 750)
SELECT ann_id, seg_id FROM c WHERE k = 1
""",
}
