"""Problem 4: the utterances most alike in voice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parolis.llm.neighbours import similar_pairs
from parolis.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "utterance_vectors")).select("utt_a", "utt_b")


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
WITH l AS (SELECT utt_id, v FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY line_no DESC) AS k
                                   FROM utterance_vectors WHERE utt_id IS NOT NULL AND line_no IS NOT NULL) WHERE k = 1),
u AS (SELECT utt_id, CAST(v AS DOUBLE[]) AS v FROM l WHERE len(v) = 192
      AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (SELECT a.utt_id AS a, b.utt_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM u a JOIN u b ON a.utt_id <> b.utt_id),
t AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS k FROM c) WHERE k <= 5 AND cos >= 0.7)
SELECT DISTINCT least(a, b) AS utt_a, greatest(a, b) AS utt_b FROM t
""",
}
