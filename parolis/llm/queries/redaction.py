"""Problem 2: personal values in segments, annotations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parolis.llm.redaction import personal_values, redacted
from parolis.runtime import table

_SOURCES = (("segments", "seg_id"), ("annotations", "ann_id"), ("documents", "doc_id"))


def _texts(spark: SparkSession, sf_dir: str, with_words: bool = False) -> DataFrame:
    out = None
    for name, key in _SOURCES:
        t = table(spark, sf_dir, name)
        words = F.transform("words", lambda w: w["word"]) if name == "segments" else F.lit(None).cast("array<string>")
        cols = [F.lit(name).alias("origin"), F.col(key).alias("row_id"), "text", *([words.alias("words")] if with_words else [])]
        out = t.select(*cols) if out is None else out.unionByName(t.select(*cols))
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_values(_texts(spark, sf_dir))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(_texts(spark, sf_dir, with_words=True))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}

SQL: dict = {}
