"""Problem 1: clean speaker turns of transcript segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parolis.llm.speaker_turns import speaker_turns, turn_heads
from parolis.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_heads(table(spark, sf_dir, "segments")).select("seg_id", "turn_in_seg", "speaker")


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(table(spark, sf_dir, "segments"))


QUERIES = {"p1_found": p1_found, "p1_turns": p1_turns}

SQL: dict = {}
