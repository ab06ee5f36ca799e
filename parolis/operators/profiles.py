"""Speaker profiles of conversations and how alike they are.

Input everywhere is one long view of segments: ``discussion, utt_id, v`` (``array<double>``) and, where durations count,
``duration``. Ids order as strings or numbers, whatever their type; every ranking breaks ties by ``utt_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parolis.functions import vec
from parolis.operators import blocks

#: Weight of a segment whose duration is unknown.
DEFAULT_WEIGHT = 2.0
#: Vectors of one block of an all-pairs product.
BLOCK = 1024


def top_by_centroid(segments: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` segments of each discussion nearest its centroid, with ``rk`` 1..k.

    The filter on the rank lets every task pass on no more than ``k`` rows a discussion, so a discussion with a large part
    of all segments is no single task.
    """
    centroids = segments.groupBy("discussion").agg(vec.mean_vector(F.col("v")).alias("centroid"))
    sims = segments.join(centroids, "discussion").withColumn("centroid_sim", vec.cosine(F.col("v"), F.col("centroid")))
    w = Window.partitionBy("discussion").orderBy(F.desc(F.round("centroid_sim", 12)), "utt_id")
    return sims.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).drop("centroid", "centroid_sim")


def top_by_duration(segments: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` longest segments of each discussion with ``rk``; segments without a duration are never among them."""
    w = Window.partitionBy("discussion").orderBy(F.desc("duration"), "utt_id")
    return segments.where(F.col("duration").isNotNull()).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def profiles(segments: DataFrame, top: DataFrame) -> DataFrame:
    """``discussion, profile`` (mean of the ``top`` segments), ``members`` (their ids in rank order, joined by commas),
    ``n_segments`` and, where durations are known, ``profile_seconds``."""
    ids = F.array_sort(F.collect_list(F.struct("rk", F.col("utt_id").cast("string").alias("id"))))
    aggs = [vec.mean_vector(F.col("v")).alias("profile"), F.array_join(F.transform(ids, lambda x: x["id"]), ",").alias("members")]
    if "duration" in top.columns:
        aggs.append(F.sum("duration").alias("profile_seconds"))
    sizes = segments.groupBy("discussion").agg(F.count("*").alias("n_segments"))
    return top.groupBy("discussion").agg(*aggs).join(sizes, "discussion")


def score_stats(score: Column) -> list[Column]:
    """Mean, least, greatest and population deviation; over nothing the mean is 1 and the others are null."""
    return [
        F.coalesce(F.avg(score), F.lit(1.0)).alias("mean_sim"), F.min(score).alias("min_sim"),
        F.max(score).alias("max_sim"), F.stddev_pop(score).alias("std_sim"), F.count(score).alias("n_evaluated"),
    ]


def intra(segments: DataFrame, top: DataFrame, prof: DataFrame) -> DataFrame:
    """Each discussion's profile against its own segments outside the profile; where there are none the mean is 1."""
    rest = segments.join(top.select("discussion", "utt_id"), ["discussion", "utt_id"], "left_anti")
    scored = rest.join(prof.select("discussion", "profile"), "discussion")
    stats = scored.groupBy("discussion").agg(*score_stats(vec.cosine(F.col("v"), F.col("profile"))))
    out = prof.drop("profile").join(stats, "discussion", "left")
    return out.withColumn("mean_sim", F.coalesce("mean_sim", F.lit(1.0))).withColumn("n_evaluated", F.coalesce("n_evaluated", F.lit(0)))


def _block_product(rows: DataFrame, visit, schema: str, block: int, unit: bool = True) -> DataFrame:
    """All ordered pairs of rows ``key, v`` block by block: each (block, block) pair meets in one group of bounded size
    and ``visit(keys_a, a, keys_b, b)`` gets two matrices of unit rows (of rows as they are without ``unit``). Nothing is
    collected or broadcast."""
    n = rows.count()
    blocks = max(1, -(-n // block))
    placed = rows.withColumn("at", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = placed.select(F.col("at").alias("i"), F.explode(others).alias("j"), F.lit(0).alias("side"), "key", "v")
    right = placed.select(F.explode(others).alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"), "key", "v")

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        keys = np.asarray(t.column("key").to_pylist(), dtype=object)
        x = np.asarray(t.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(len(side), -1)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vec.EPS) if unit else x
        return visit(keys[side == 0], x[side == 0], keys[side == 1], x[side == 1])

    return left.unionByName(right).groupBy("i", "j").applyInArrow(run, schema)


def all_pairs(prof: DataFrame, key: str = "discussion", vector: str = "profile", block: int = BLOCK, unit: bool = True) -> DataFrame:
    """``ref, target, sim`` for all ordered pairs of different keys (as strings), by block matrix products; without
    ``unit`` the inner products."""

    def visit(ka, a, kb, b) -> pa.Table:
        s = a @ b.T
        i, j = np.nonzero(ka[:, None] != kb[None, :])
        return pa.table({"ref": pa.array(ka[i], pa.string()), "target": pa.array(kb[j], pa.string()), "sim": pa.array(s[i, j], pa.float64())})

    rows = prof.select(F.col(key).cast("string").alias("key"), F.col(vector).alias("v"))
    return _block_product(rows, visit, "ref string, target string, sim double", block, unit)


def nearest_keys(keys: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest of each row, ties by key; ``-inf`` never counts."""
    order = np.argsort(keys.astype(str), kind="stable")
    best = order[np.argsort(-sims[:, order], axis=1, kind="stable")[:, :k]]
    row, col = np.repeat(np.arange(len(sims)), best.shape[1]), best.ravel()
    real = np.isfinite(sims[row, col])
    return row[real], col[real]


def nearest_profiles(prof: DataFrame, n: int, decimals: int = 12, block: int = BLOCK) -> DataFrame:
    """``ref, target, sim, rank``: the ``n`` most similar profiles of each, ties of the rounded similarity by target. A
    block sends no more than ``n`` rows a profile."""

    def visit(ka, a, kb, b) -> pa.Table:
        s = np.where(ka[:, None] == kb[None, :], -np.inf, (a @ b.T).round(decimals)) if len(kb) else np.empty((len(ka), 0))
        i, j = nearest_keys(kb, s, n)
        return pa.table({"ref": pa.array(ka[i], pa.string()), "target": pa.array(kb[j], pa.string()), "sim": pa.array(s[i, j], pa.float64())})

    rows = prof.select(F.col("discussion").cast("string").alias("key"), F.col("profile").alias("v"))
    found = _block_product(rows, visit, "ref string, target string, sim double", block)
    w = Window.partitionBy("ref").orderBy(F.desc("sim"), "target")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


PAIRS = "ref string, target string, n_pairs bigint, mean_sim double, min_sim double, max_sim double, std_sim double"


def _statistics(n, s, ss, lo, hi) -> dict:
    mean = s / n
    return {"n_pairs": pa.array(n, pa.int64()), "mean_sim": mean, "min_sim": lo, "max_sim": hi, "std_sim": np.sqrt(np.maximum(ss / n - mean**2, 0.0))}


def inner_statistics(segments: DataFrame) -> DataFrame:
    """Statistics of the cosines of the unordered pairs of different segments of each discussion: ``ref, target`` (both the
    discussion) and the rest as in ``pair_statistics``. One exchange by discussion; the vectors of one discussion must fit a
    task, its pairs are formed tile by tile."""

    def one(t: pa.Table) -> tuple:
        u = blocks.unit(blocks.matrix(t.column("v")))
        nth = np.unique(t.column("utt_id").to_numpy(), return_inverse=True)[1]
        n, s, ss, lo, hi = 0, 0.0, 0.0, np.inf, -np.inf
        for i in range(0, len(u), blocks.TILE):
            for j in range(i, len(u), blocks.TILE):
                x = u[i : i + blocks.TILE] @ u[j : j + blocks.TILE].T
                differ = nth[i : i + blocks.TILE, None] != nth[None, j : j + blocks.TILE]
                x = x[np.triu(differ, 1) if i == j else differ]
                if len(x):
                    n, s, ss, lo, hi = n + len(x), s + x.sum(), ss + (x**2).sum(), min(lo, x.min()), max(hi, x.max())
        return n, s, ss, lo, hi

    def run(batches):
        for whole in blocks.grouped(batches, "discussion"):
            found = [(t.column("discussion")[0].as_py(), *one(t)) for t in blocks._groups(whole, "discussion")]
            names, *sums = zip(*[f for f in found if f[1]]) if any(f[1] for f in found) else [()] * 6
            ref = pa.array(names, pa.string())
            yield pa.RecordBatch.from_pydict({"ref": ref, "target": ref, **_statistics(*(np.asarray(x, dtype=np.float64) for x in sums))})

    rows = segments.select(F.col("discussion").cast("string").alias("discussion"), "utt_id", "v")
    return blocks.by_group(rows, "discussion").mapInArrow(run, PAIRS)


def pair_statistics(segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """Statistics of the cosines of all segment pairs: ``ref, target, n_pairs, mean_sim, min_sim, max_sim, std_sim``.

    Within a discussion (``ref = target``) each unordered pair of different segments counts once, between two
    discussions each (ref, target) pair.
    """
    return inner_statistics(segments).unionByName(outer_statistics(segments, block))


def outer_statistics(segments: DataFrame, block: int = BLOCK, decimals: int | None = None) -> DataFrame:
    """``pair_statistics`` between different discussions, rounded half up to ``decimals``. No block ends inside a discussion,
    so a pair of discussions is one rectangle of one product and its statistics are not shuffled.

    The cosines of two discussions are formed once, for (ref, target) and (target, ref). Rows of both ways stand close
    together, as files of them then compress to about half.
    """

    class Visitor:
        def __init__(self, keys, x) -> None:
            self.names, self.starts = _runs(np.asarray(keys, dtype=object))
            self.x, self.sizes = blocks.unit(x), np.diff([*self.starts, len(x)])

        def see(self, keys, x):
            names, starts = _runs(np.asarray(keys, dtype=object))
            y, sizes = blocks.unit(x), np.diff([*starts, len(x)])
            i = 0
            while i < len(self.names):
                j = self.until(i, len(y), len(names))
                yield self.rectangle(i, j, names, starts, sizes, y, False)
                i = j

        def end(self):
            i = 0
            while i < len(self.names) - 1:
                first = self.starts[i]
                j = self.until(i, len(self.x) - first, len(self.names) - i)
                yield self.rectangle(i, j, self.names[i:], self.starts[i:] - first, self.sizes[i:], self.x[first:], True)
                i = j

        def until(self, i: int, width: int, names: int) -> int:
            """The end of some discussions at a time; those of many segments stand alone."""
            j = i + 1
            while j < len(self.names) and self.sizes[i : j + 1].sum() <= min(256, _tile(width)) and (j + 1 - i) * names <= 2**16:
                j += 1
            return j

        def rectangle(self, i, j, names, starts, sizes, y, own) -> tuple:
            total = [np.empty((j - i, len(names))) for _ in range(4)]
            first, last = self.starts[i], self.starts[j - 1] + self.sizes[j - 1]
            for r in range(first, last, _tile(len(y))):  # a discussion of many segments is cut into tiles
                end = min(last, r + _tile(len(y)))
                s = self.x[r:end] @ y.T
                for d in range(i, j):
                    x = s[max(0, self.starts[d] - r) : self.starts[d] + self.sizes[d] - r]
                    part = x.sum(axis=0), np.einsum("ij,ij->j", x, x), x.min(axis=0), x.max(axis=0)
                    for t, p, f in zip(total, part, (np.add, np.add, np.minimum, np.maximum)):
                        p = f.reduceat(p, starts)
                        t[d - i] = p if r == first else f(t[d - i], p)
            n = self.sizes[i:j, None] * sizes[None, :]
            found = _statistics(n.ravel(), *(t.ravel() for t in total))
            stats = {k: x if decimals is None or k == "n_pairs" else _half_up(x, decimals) for k, x in found.items()}
            return self.names[i:j].tolist(), names.tolist(), own, {k: np.asarray(x).reshape(n.shape) for k, x in stats.items()}

    rows = segments.select(F.col("discussion").cast("string").alias("key"), "v")
    return blocks.streamed(blocks.by_group(rows, "key"), block, Visitor, PAIRS, whole=True, unpack=_both_ways)


def _tile(width: int) -> int:
    return max(1, min(blocks.TILE, 2**22 // width))


def _half_up(x: np.ndarray, decimals: int) -> np.ndarray:
    x = x * 10.0**decimals
    return np.trunc(x + np.copysign(0.5, x)) / 10.0**decimals + 0.0


def _both_ways(found: tuple):
    """Rows of a rectangle of discussions: those of one ref, then the same with ref and target changed. With ``own`` the
    rectangle begins with the refs themselves, and only targets behind a ref count."""
    refs, targets, own, stats = found
    names = pa.array([*refs, *targets], pa.string())
    i, j = np.broadcast_arrays(np.arange(len(refs))[:, None], len(refs) + np.arange(len(targets))[None, :])
    kept = np.broadcast_to(j - len(refs) > i if own else np.True_, i.shape)
    kept = np.stack([kept, kept], axis=1)
    both = lambda a, b: np.stack([a, b], axis=1)[kept]
    ref, target = names.take(pa.array(both(i, j))), names.take(pa.array(both(j, i)))
    yield pa.RecordBatch.from_pydict({"ref": ref, "target": target, **{k: pa.array(both(x, x)) for k, x in stats.items()}})


def _runs(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names in order of occurrence and where each begins."""
    starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    return names[starts], starts


def nearest_own(segments: DataFrame, k: int = 3) -> DataFrame:
    """Each discussion's profile of the ``k`` segments nearest its centroid, and its cosines with the other segments:
    ``discussion, profile, members, n_segments, mean_sim, min_sim, max_sim, std_sim, n_evaluated`` as ``intra`` gives over
    ``top_by_centroid``. One exchange of the vectors as they are; those of one discussion must fit a task."""

    def one(t: pa.Table) -> tuple:
        v = blocks.matrix(t.column("v")).astype(np.float64)
        ids, u = np.asarray(t.column("utt_id").to_pylist(), dtype=object), blocks.unit(v)
        order = np.argsort(ids, kind="stable")
        best = order[np.argsort(-(u @ blocks.unit(v.mean(axis=0)[None, :])[0]).round(12)[order], kind="stable")[:k]]
        profile = v[best].mean(axis=0)
        rest = np.delete(u, best, axis=0) @ blocks.unit(profile[None, :])[0]
        stats = (rest.mean(), rest.min(), rest.max(), rest.std()) if len(rest) else (1.0, None, None, None)
        return t.column("discussion")[0].as_py(), profile, ",".join(map(str, ids[best])), len(v), *stats, len(rest)

    schema = "discussion string, profile array<double>, members string, n_segments bigint, mean_sim double, min_sim double, max_sim double, std_sim double, n_evaluated bigint"
    kinds = [pa.string(), pa.list_(pa.float64()), pa.string(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for whole in blocks.grouped(batches, "discussion"):
            cols = zip(*(one(t) for t in blocks._groups(whole, "discussion")))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds)], names)

    rows = segments.select(F.col("discussion").cast("string").alias("discussion"), "utt_id", "v")
    return blocks.by_group(rows, "discussion").mapInArrow(run, schema)


def unit_means(segments: DataFrame) -> DataFrame:
    """Mean of each discussion's unit vectors: the mean cosine of all pairs between two discussions is the product of
    theirs, without forming a pair."""
    return segments.groupBy("discussion").agg(vec.mean_vector(vec.unit(F.col("v"))).alias("profile"), F.count("*").alias("n_segments"))


def weighted_profiles(segments: DataFrame, weighted: bool = True) -> DataFrame:
    """Profile by duration weights that sum to 1 (``DEFAULT_WEIGHT`` where unknown), or the plain centroid."""
    w = F.coalesce(F.col("duration"), F.lit(DEFAULT_WEIGHT)) if weighted else F.lit(1.0)
    return segments.groupBy("discussion").agg(vec.mean_vector(F.col("v"), w).alias("profile"), F.count("*").alias("n_segments"))


def split_half(segments: DataFrame, weighted: bool = True) -> DataFrame:
    """``discussion, n_segments, split_half, segment_vs_profile``: the cosine of the profiles of every other segment in
    order of id, and the mean cosine of the segments with the whole profile. One segment alone gives 1."""
    w = F.coalesce(F.col("duration"), F.lit(DEFAULT_WEIGHT)) if weighted else F.lit(1.0)
    nth = F.row_number().over(Window.partitionBy("discussion").orderBy("utt_id"))
    rows = segments.withColumn("half", (nth - 1) % 2).withColumn("w", w)
    # one aggregate for both halves: the other half's weight is 0
    halves = rows.groupBy("discussion", "half").agg(vec.mean_vector(F.col("v"), F.col("w")).alias("p"))
    even, odd = (halves.where(F.col("half") == h).select("discussion", F.col("p").alias(f"p{h}")) for h in (0, 1))
    both = even.join(odd, "discussion", "left")
    sim = F.coalesce(vec.cosine(F.col("p0"), F.col("p1")), F.lit(1.0))
    whole = weighted_profiles(segments, weighted)
    own = rows.join(whole.select("discussion", "profile"), "discussion").groupBy("discussion")
    own = own.agg(F.avg(vec.cosine(F.col("v"), F.col("profile"))).alias("segment_vs_profile"))
    return whole.select("discussion", "n_segments").join(both.select("discussion", sim.alias("split_half")), "discussion").join(own, "discussion")
