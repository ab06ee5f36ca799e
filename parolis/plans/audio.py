"""Signal queries; a vector of ``embeddings`` stands for a short signal of 400 samples a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parolis.functions import audio
from parolis.runtime import table

RATE = 400


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", audio.quality_record(F.col("x"), RATE, prepare=False).alias("q")).select("vec_id", "q.*")


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    score = audio.quality_of(F.col("total_duration"), F.col("snr"), F.col("rms"), F.col("speech_ratio"))
    return r.select("vec_id", *[F.round(c, 6).alias(c) for c in ("rms", "snr", "speech_ratio", "total_duration")], F.round(score, 6).alias("quality"))


def snr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return r.select("vec_id", F.round("gate_snr", 6).alias("snr"), F.when(F.col("gate_snr") >= audio.GATE_DB, "clean").otherwise("noisy").alias("decision"))


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snr_gate(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"))


QUERIES = {"quality_score": quality_score, "snr_gate": snr_gate, "gate_counts": gate_counts}

_E = """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
f AS (SELECT vec_id, x, list_transform(range(0, 54, 4), lambda i: list_sum(list_transform(x[i+1:i+10], lambda y: y * y))) AS e FROM x),
g AS (SELECT vec_id, x, list_filter(e, lambda y: y > 0.005 * list_max(e)) AS hi, list_filter(e, lambda y: y <= 0.005 * list_max(e)) AS lo,
  list_filter(e, lambda y: y > 0.1 * list_max(e)) AS hi1, list_filter(e, lambda y: y <= 0.1 * list_max(e)) AS lo1, len(e) AS n FROM f),
r AS (SELECT vec_id, sqrt(list_avg(list_transform(x, lambda y: y * y))) AS rms, len(hi) / n AS speech_ratio, 64 / 400.0 AS total_duration,
  10 * log10(list_avg(hi) / greatest(coalesce(list_avg(lo), 1e-10), 1e-10)) AS gate,
  CASE WHEN len(lo1) = 0 OR len(hi1) = 0 THEN 0.0 WHEN list_avg(lo1) > 1e-10 THEN 10 * log10(list_avg(hi1) / list_avg(lo1)) ELSE 30.0 END AS snr FROM g)"""

SQL = {
    "quality_score": _E + """SELECT vec_id, round(rms, 6) AS rms, round(snr, 6) AS snr, round(speech_ratio, 6) AS speech_ratio, round(total_duration, 6) AS total_duration,
  round(0.25 * exp(-power(total_duration - 3.5, 2) / 5) + 0.30 / (1 + exp(-(snr - 12) / 4)) + 0.20 * least(1.0, rms * 60) + 0.25 * least(1.0, speech_ratio * 2.5), 6) AS quality FROM r""",
    "snr_gate": _E + "SELECT vec_id, round(gate, 6) AS snr, CASE WHEN gate >= 20 THEN 'clean' ELSE 'noisy' END AS decision FROM r",
    "gate_counts": _E + "SELECT CASE WHEN gate >= 20 THEN 'clean' ELSE 'noisy' END AS decision, count(*) AS n FROM r GROUP BY 1",
}
