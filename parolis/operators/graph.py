"""Similarity graphs of conversations: clusters, networks, reciprocity, triads. Edges are rows ``ref, target``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of a link: none, reciprocal, dominant (one way), reinforced by a triad.
LEVELS = {0: "none", 1: "reciprocal", 2: "dominant", 3: "triad"}


def cluster_edges(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pairs ``ref, target, sim`` whose similarity exceeds the reference's threshold (``ref, threshold``), strictly."""
    return pairs.join(thresholds, "ref").where(F.col("sim") > F.col("threshold"))


def clusters(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``ref, threshold, n_members, members`` for every reference, members in order joined by commas."""
    found = cluster_edges(pairs, thresholds).groupBy("ref").agg(
        F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list("target")), ",").alias("members")
    )
    out = thresholds.join(found, "ref", "left")
    return out.select(
        "ref", "threshold", F.coalesce("n_members", F.lit(0)).alias("n_members"), F.coalesce("members", F.lit("")).alias("members")
    )


def top_n(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most similar targets of each reference with ``rank`` 1..n; ties by target."""
    w = Window.partitionBy("ref").orderBy(F.desc(F.round("sim", 12)), "target")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def with_reciprocal(edges: DataFrame) -> DataFrame:
    """Edges with ``reciprocal``: whether the opposite edge exists."""
    back = edges.select(F.col("target").alias("ref"), F.col("ref").alias("target")).distinct().withColumn("reciprocal", F.lit(True))
    return edges.join(back, ["ref", "target"], "left").withColumn("reciprocal", F.coalesce("reciprocal", F.lit(False)))


def with_levels(edges: DataFrame) -> DataFrame:
    """Edges with ``level``: 3 where some third node C has ref -> C and C -> target, else 1 if reciprocal, else 2.

    The two-hop join goes through the middle node and is reduced to the edges that exist by a semi join on both ends. A
    reciprocal edge with a triad is level 3, as reinforced links go before the other kinds; a one-way edge is 2.
    """
    e = edges.select("ref", "target").distinct()
    first = e.select("ref", F.col("target").alias("mid"))
    second = e.select(F.col("ref").alias("mid"), F.col("target").alias("target"))
    flagged = with_reciprocal(e)
    # start from the edges that could be reinforced, so that only their hops are formed
    hops = flagged.where("reciprocal").select("ref", "target").join(first, "ref").where(F.col("mid") != F.col("target"))
    triads = hops.join(second, ["mid", "target"], "left_semi").select("ref", "target").distinct().withColumn("triad", F.lit(True))
    out = flagged.join(triads, ["ref", "target"], "left")
    level = F.when(F.col("triad"), 3).when(F.col("reciprocal"), 1).otherwise(2)
    return out.select("ref", "target", level.alias("level"))


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, n_in`` for every node, isolated ones included."""
    n = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n_in"))
    return nodes.select("node").distinct().join(n, "node", "left").select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"))


def level_counts(levels: DataFrame) -> DataFrame:
    """Per reference the number of reciprocal, dominant and reinforced links."""
    return levels.groupBy("ref").agg(
        *[F.count(F.when(F.col("level") == k, 1)).alias(f"n_{LEVELS[k]}") for k in (1, 2, 3)]
    )


def sparse_matrix(levels: DataFrame) -> DataFrame:
    """``ref, row``: the links of each reference as ``target=level``, in order of target, joined by commas. References and
    targets without a link do not occur."""
    cells = F.array_sort(F.collect_list(F.struct("target", "level")))
    return levels.groupBy("ref").agg(F.array_join(F.transform(cells, lambda x: F.concat_ws("=", x["target"], x["level"].cast("string"))), ",").alias("row"))


def matrix(levels: DataFrame, targets: list[str], prefix: str = "t_") -> DataFrame:
    """Wide form for a report: one row a reference, one column a target, 0 where there is no link."""
    wide = levels.groupBy("ref").pivot("target", targets).agg(F.first("level"))
    column = lambda t: F.col("`" + t.replace("`", "``") + "`")
    return wide.select("ref", *[F.coalesce(column(t), F.lit(0)).alias(prefix + t) for t in targets])
