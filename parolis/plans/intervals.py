"""Problem 5: continuous periods of speech and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parolis.operators.intervals import periods_and_gaps
from parolis.operators.turns import call_id, speaker_key
from parolis.runtime import table, to_ms


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns").select(
        call_id(F.col("file")).alias("audio_id"),
        speaker_key(F.col("speaker")).alias("speaker"),
        to_ms(F.col("start")).alias("s"),
        to_ms(F.col("end")).alias("e"),
    )
    return periods_and_gaps(t, ["audio_id", "speaker"], "s", "e", max_gap=120_000)


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": r"""
WITH t AS (
  SELECT regexp_replace(regexp_replace(trim(file), '^.*[/\\]', ''), '\.wav$', '', 'i') AS audio_id,
         lower(trim(speaker)) AS speaker,
         CAST(round(start * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e
  FROM turns WHERE file IS NOT NULL AND speaker IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL),
v AS (SELECT * FROM t WHERE e > s),
r AS (SELECT *, max(e) OVER (PARTITION BY audio_id, speaker ORDER BY s, e
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
                OVER (PARTITION BY audio_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
p AS (SELECT audio_id, speaker, island, min(s) AS a, max(e) AS b FROM n GROUP BY ALL),
g AS (SELECT audio_id, speaker, b AS a, lead(a) OVER (PARTITION BY audio_id, speaker ORDER BY island) AS b FROM p)
SELECT audio_id, speaker, 'period' AS kind, a AS start_ms, b AS end_ms FROM p
UNION ALL
SELECT audio_id, speaker, 'gap', a, b FROM g WHERE b IS NOT NULL AND b - a <= 120000
""",
}
