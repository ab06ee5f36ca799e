"""Problem 8: long exact spans shared between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parolis.llm.shared_spans import shared_share, shared_spans
from parolis.runtime import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(table(spark, sf_dir, "documents"))


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares}

_STRETCHES = """
WITH g AS (SELECT doc_id, i AS pos, md5(substring(text, i + 1, 240)) AS h
           FROM documents, unnest(range(0, length(text) - 239)) AS u(i) WHERE length(text) >= 240),
s AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
f AS (SELECT DISTINCT doc_id, pos FROM g JOIN s USING (h)),
m AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 240 THEN 0 ELSE 1 END AS fresh FROM f),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM m),
r AS (SELECT doc_id, min(pos) AS char_start, max(pos) + 240 AS char_end FROM k GROUP BY doc_id, k)
"""

SQL = {
    "p8_found": _STRETCHES + "SELECT doc_id, char_start, char_end FROM r",
    "p8_shares": _STRETCHES
    + """, c AS (SELECT doc_id, CAST(sum(char_end - char_start) AS BIGINT) AS c FROM r GROUP BY doc_id)
SELECT DISTINCT d.doc_id, CAST(length(text) AS BIGINT) AS n_chars, coalesce(c, 0) AS shared_chars,
       CASE WHEN length(text) > 0 THEN round(coalesce(c, 0) / length(text), 6) ELSE 0.0 END AS share
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id WHERE text IS NOT NULL""",
}
