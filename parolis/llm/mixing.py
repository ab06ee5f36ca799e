"""Mix sources to target shares of the total size, with a cap on repeats.

Documents are counted by source and exact length in tokens; the counts, not the documents, go to the driver (sources
times distinct lengths). There the budget of each source is fitted: whole passes over the source first, then a
proportional part of every length, then a bounded-knapsack dynamic program over the lengths left closes the rest to
the token. Back on the cluster every (source, length) takes its number of documents in seeded order. The order is cut
by bins of the seeded hash, so that only one bin in a group is ever sorted, however many documents share a length.
"""

from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parolis.llm.tokens import VOCABULARY, counted
from parolis.runtime import cut_lineage

#: Bins of the seeded order of one (source, length); rows of quotas that are still broadcast.
BINS = 256
#: Documents of each length up to ``SHORT`` tokens that the dynamic program chooses anew.
GIVEN_BACK, SHORT = 16, 64
BROADCAST_ROWS = 200_000


@dataclass
class Fit:
    """What one source gives to one plan: each document ``passes`` times, and ``extra[length]`` documents once more."""

    passes: int
    extra: dict[int, int]
    tokens: int


def fit_lengths(counts: dict[int, int], budget: int, cap: int, seed: int = 0) -> Fit:
    """Documents of given lengths that add up to ``budget`` as exactly as ``cap`` uses of each allow, never above it."""
    whole = sum(n * c for n, c in counts.items())
    if whole <= 0 or budget <= 0 or cap <= 0:
        return Fit(0, {}, 0)
    passes = min(cap, budget // whole)
    rest = budget - passes * whole
    if passes == cap or not rest:
        return Fit(passes, {}, passes * whole)
    lengths = sorted(counts)
    random.Random(seed).shuffle(lengths)
    extra = {n: counts[n] * rest // whole for n in lengths}
    rest -= sum(n * c for n, c in extra.items())
    keep = 3 * max(lengths)  # for the dynamic program
    moved = True
    while rest > keep and moved:
        moved = False
        for n in lengths:
            if extra[n] < counts[n] and rest - n >= keep:
                extra[n] += 1
                rest -= n
                moved = True
    for n in lengths:  # some short documents go back, so that the program can also choose to leave them out
        back = min(extra[n], GIVEN_BACK) if n <= SHORT else 0
        extra[n] -= back
        rest += back * n
    # reachable sums as bits of one integer; each part is 1, 2, 4, ... documents of a length
    reach, parts, mask = 1, [], (1 << (rest + 1)) - 1
    for n in lengths:
        left, size = min(counts[n] - extra[n], rest // n), 1
        while left > 0 and not reach >> rest & 1:
            k = min(size, left)
            parts.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left, size = left - k, size * 2
    at = reach.bit_length() - 1
    rest -= at
    for n, k, before in reversed(parts):
        if not before >> at & 1:
            extra[n] += k
            at -= n * k
    return Fit(passes, {n: c for n, c in extra.items() if c}, budget - rest)


def valid_plans(rows: list[tuple]) -> dict[int, dict[str, tuple[float, int]]]:
    """plan -> source -> (share, cap) of rows (plan_id, source, target_share, max_repeats).

    Rows without plan, source or a positive finite share say nothing. A source named twice has the sum of its shares and
    the smaller cap; a null cap is 1. Shares of a plan are scaled to add up to 1.
    """
    plans: dict = defaultdict(dict)
    for plan, source, share, cap in rows:
        if plan is None or source is None or share is None or not 0 < share < float("inf"):
            continue
        cap = 1 if cap is None else max(0, cap)
        old = plans[plan].get(source)
        plans[plan][source] = (share + old[0], min(cap, old[1])) if old else (share, cap)
    return {p: {s: (x / sum(y for y, _ in v.values()), c) for s, (x, c) in v.items()} for p, v in plans.items()}


def fit_plan(
    plan: dict[str, tuple[float, int]], counts: dict[str, dict[int, int]], total: int | None, seed: int
) -> dict[str, Fit]:
    """A fit for each source of a plan that has documents and may use them; the others' shares go to these in proportion.

    Without ``total`` the mix is the largest that meets all shares within the caps.
    """
    size = {s: sum(n * c for n, c in counts.get(s, {}).items()) for s in plan}
    usable = {s: v for s, v in plan.items() if size[s] > 0 and v[1] > 0}
    scale = sum(x for x, _ in usable.values())
    if not usable:
        return {}
    budget = total if total is not None else min(c * size[s] * scale / x for s, (x, c) in usable.items())
    return {
        s: fit_lengths(counts[s], int(budget * x / scale + 1e-6), c, seed) for s, (x, c) in sorted(usable.items())
    }


def sized_documents(df: DataFrame, doc_id: str, text: str, source: str, vocabulary: str) -> DataFrame:
    """``doc_id, source, n_tokens`` of documents that have an id, a source and at least one token; ids once."""
    x = df.select(df[doc_id].cast("bigint").alias("doc_id"), df[source].cast("string").alias("source"), df[text].cast("string").alias("text"))
    x = x.where("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
    x = x.mapInArrow(counted(df.sparkSession, vocabulary), "doc_id bigint, source string, n_tokens bigint").where("n_tokens > 0")
    once = x.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("x"))
    return once.select("doc_id", "x.source", "x.n_tokens")


def mix_sources(
    documents: DataFrame, plan: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    vocabulary: str = VOCABULARY, total_tokens: int | None = None, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """The choice ``plan_id, source, doc_id, n_tokens, repeats`` and the report ``plan_id, source, target_share,
    effective_share, max_repeats, n_docs, n_rows, most_repeats, tokens, share`` with a row for every source of every plan.

    ``plan`` has ``plan_id, source, target_share, max_repeats`` and is small (it goes to the driver). Dirty plans are
    read as in :func:`valid_plans`; a source without documents is reported with share 0 and its target is shared out to
    the others in proportion: ``effective_share`` is what is aimed at then, and what ``share`` should be compared with. Documents with null id, null source, null or empty text are no candidates; a repeated id
    counts once. Empty tables give empty results. The choice is the same for the same rows and seed.
    """
    spark = documents.sparkSession
    sized = cut_lineage(sized_documents(documents, doc_id, text, source, vocabulary))
    counts: dict = defaultdict(dict)
    for r in sized.groupBy("source", "n_tokens").count().collect():
        counts[r.source][r.n_tokens] = r["count"]
    plans = valid_plans([tuple(r) for r in plan.select("plan_id", "source", "target_share", "max_repeats").collect()])
    fits = {p: fit_plan(v, counts, total_tokens, seed) for p, v in plans.items()}

    quotas = [
        (p, s, n, f.passes, f.extra.get(n, 0), c)
        for p, by_source in fits.items()
        for s, f in by_source.items()
        for n, c in counts[s].items()
        if f.passes or n in f.extra
    ]
    q = spark.createDataFrame(quotas, "plan_id int, source string, n_tokens bigint, passes int, extra bigint, n bigint")
    if len(quotas) <= BROADCAST_ROWS:
        q = F.broadcast(q)
    rows = sized.join(q, ["source", "n_tokens"]).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))

    # groups that give all or none of their documents need no order
    plain = rows.where("extra = 0 OR extra = n").withColumn("more", (F.col("extra") > 0).cast("int"))
    cut = rows.where("extra > 0 AND extra < n").withColumn("bin", F.pmod(F.shiftright("h", 20), F.lit(BINS)))
    group = ["plan_id", "source", "n_tokens"]
    up_to = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = cut.groupBy(*group, "bin").agg(F.count("*").alias("c"), F.first("extra").alias("x"))
    bins = bins.withColumn("take", F.col("x") - F.coalesce(F.sum("c").over(up_to), F.lit(0))).where("take > 0").select(*group, "bin", "c", "take")
    chosen = cut.join(bins, [*group, "bin"], "left")
    full = chosen.where("take >= c").withColumn("more", F.lit(1))
    none = chosen.where("take IS NULL AND passes > 0").withColumn("more", F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*group, "bin").orderBy("h", "doc_id"))
    part = chosen.where("take < c").withColumn("more", (rank <= F.col("take")).cast("int"))
    cols = ["plan_id", "source", "doc_id", "n_tokens", (F.col("passes") + F.col("more")).alias("repeats")]
    choice = plain.select(*cols).unionByName(full.select(*cols)).unionByName(none.select(*cols)).unionByName(part.select(*cols))
    choice = choice.where("repeats > 0")

    kept = {p: sum(x for s, (x, _) in v.items() if s in fits[p]) for p, v in plans.items()}
    wanted = [(p, s, x, x / kept[p] if s in fits[p] else 0.0, c) for p, v in plans.items() for s, (x, c) in v.items()]
    targets = spark.createDataFrame(wanted, "plan_id int, source string, target_share double, effective_share double, max_repeats int")
    got = choice.groupBy("plan_id", "source").agg(
        F.count("*").alias("n_docs"), F.sum("repeats").alias("n_rows"), F.max("repeats").alias("most_repeats"),
        F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"),
    )
    report = targets.join(got, ["plan_id", "source"], "left").fillna(0, ["n_docs", "n_rows", "most_repeats", "tokens"])
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("plan_id")), F.lit(0))
    return choice, report.withColumn("share", F.round(F.coalesce(share, F.lit(0.0)), 6)).withColumns({c: F.round(c, 6) for c in ("target_share", "effective_share")})
