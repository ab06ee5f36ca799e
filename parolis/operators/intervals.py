"""Continuous periods and gaps of overlapping intervals.

The classical plan sorts one entity's intervals, compares each start with the running maximum of the ends before it,
and numbers the islands with a running count. Run as one window per entity, an entity that holds a third of all rows
lands in a single task. Here the same three steps run twice: inside time slices of an entity (evenly sized, any
executor), then over one summary row per slice. The slices meet again through two carried values only: the greatest
end reached before the slice and the number of islands that began before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time slice in the unit of the intervals (ms in the registered queries): ten minutes.
SLICE = 600_000


def merged_periods(df: DataFrame, keys: list[str], start: str, end: str, slice_width: int = SLICE) -> DataFrame:
    """Merge overlapping, nested and touching intervals of each entity into periods.

    ``keys`` name the entity; ``start`` and ``end`` are integers of one unit. Returns ``keys``, ``island`` (1, 2, ...
    in order of time), ``period_start``, ``period_end`` and ``gap_start``: the end of the period before, null for the
    first period of an entity.

    Rows with a null in a key, in start or in end, and rows with end <= start are ignored. Repeated rows count once.
    Other columns of ``df``, whatever their names, are not read. An empty table gives an empty result.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[df[k].alias(n) for k, n in zip(keys, names)],
        df[start].cast("bigint").alias("s"),
        df[end].cast("bigint").alias("e"),
    ).where(F.col("e") > F.col("s"))
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    rows = rows.withColumn("slice", F.floor(F.col("s") / slice_width))

    in_slice = Window.partitionBy(*names, "slice")
    ordered = in_slice.orderBy("s", "e")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)

    # 1. within a slice: islands of their own; one exchange on (keys, slice) serves the windows and the aggregate
    local = rows.withColumn("reach", F.max("e").over(before))
    local = local.withColumn("new", (F.col("reach").isNull() | (F.col("s") > F.col("reach"))).cast("int"))
    local = local.withColumn("li", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.groupBy(*names, "slice", "li").agg(F.min("s").alias("s"), F.max("e").alias("e"))

    # 2. one row per slice, then carry the greatest end from slice to slice
    per_slice = local.groupBy(*names, "slice").agg(F.max("e").alias("top"))
    along = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*names, "slice", F.max("top").over(along).alias("carry"))

    joined = local.join(carried, [*names, "slice"])
    reach = F.greatest("carry", F.max("e").over(in_slice.orderBy("li").rowsBetween(Window.unboundedPreceding, -1)))
    joined = joined.withColumn("reach", reach)
    joined = joined.withColumn("new", (F.col("reach").isNull() | (F.col("s") > F.col("reach"))).cast("bigint"))
    joined = joined.withColumn(
        "nth", F.sum("new").over(in_slice.orderBy("li").rowsBetween(Window.unboundedPreceding, 0))
    )

    # 3. islands begun before the slice, again from one row per slice
    begun = joined.groupBy(*names, "slice").agg(F.sum("new").alias("n"))
    begun = begun.select(*names, "slice", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    numbered = joined.join(begun, [*names, "slice"]).withColumn("island", F.col("nth") + F.col("before"))

    periods = numbered.groupBy(*names, "island").agg(
        F.min("s").alias("period_start"),
        F.max("e").alias("period_end"),
        F.max(F.when(F.col("new") == 1, F.col("reach"))).alias("gap_start"),
    )
    return periods.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], "island", "period_start", "period_end", "gap_start"
    )


def periods_and_gaps(
    df: DataFrame, keys: list[str], start: str, end: str, max_gap: int | None = None, slice_width: int = SLICE
) -> DataFrame:
    """Periods and the gaps between consecutive ones, as rows ``keys, kind, start_ms, end_ms``.

    ``kind`` is ``period`` or ``gap``; gaps longer than ``max_gap`` are left out (null: none is). Null, empty, tied and
    repeated input is treated as in :func:`merged_periods`.
    """
    periods = merged_periods(df, keys, start, end, slice_width)
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("period_start").alias("a"), F.col("period_end").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.col("gap_start").alias("a"), F.col("period_start").alias("b")),
    )
    # one pass over the periods instead of a union that would compute them twice
    out = periods.select(*keys, F.explode(kinds).alias("x")).where(F.col("x.a").isNotNull())
    if max_gap is not None:
        out = out.where((F.col("x.kind") == "period") | (F.col("x.b") - F.col("x.a") <= max_gap))
    return out.select(*keys, F.col("x.kind").alias("kind"), F.col("x.a").alias("start_ms"), F.col("x.b").alias("end_ms"))
