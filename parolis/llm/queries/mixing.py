"""Problem 7: documents of the seven sources combined by each plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parolis.llm.mixing import mix_sources
from parolis.runtime import table


def p7_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plan"))[1]


QUERIES = {"p7_choice": p7_choice, "p7_shares": p7_shares}

SQL: dict = {}
