"""Problem 6: documents that hold passages of the evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parolis.llm.leaks import leaked_items
from parolis.runtime import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": r"""
WITH f AS (SELECT doc_id AS id, 0 AS held, text FROM documents UNION ALL SELECT item_id, 1, text FROM eval_items),
w AS (SELECT id, held, regexp_extract_all(replace(lower(regexp_replace(nfkd, '\p{M}', '', 'g')), 'œ', 'oe'), '[\p{L}\p{N}]+') AS w
      FROM (SELECT id, held, strip_accents(replace(replace(text, 'Œ', 'oe'), '…', '...')) AS nfkd FROM f)),
g AS (SELECT DISTINCT id, held, array_to_string(w[i:i+11], ' ') AS gram FROM w, unnest(range(1, len(w) - 10)) AS u(i) WHERE len(w) >= 12)
SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM g AS d JOIN g AS e ON d.gram = e.gram WHERE d.held = 0 AND e.held = 1
""",
}
