"""Pair each record with the nearest record in time of the same entity, within a tolerance.

A shard is one time slice of one entity; the right side is copied into the neighbouring shard where it lies within the
tolerance of an edge, so every left record finds all its partners in its own shard and an entity that holds a third of
all rows spreads over as many shards as it has slices. Inside a shard the right side is a sorted array; a
piecewise-linear model predicts a position in it with bounded error and a bounded binary search around the prediction
gives the exact neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a shard in ms, error bound of the learned index in positions.
SHARD_MS = 600_000
EPSILON = 16


class LearnedIndex:
    """Piecewise-linear positions of a sorted array of distinct integers, each off by at most ``epsilon``.

    Pieces come from the shrinking cone: a piece grows while some line through its first point stays within
    ``epsilon`` of every position.
    """

    def __init__(self, keys: np.ndarray, epsilon: int = EPSILON):
        self.keys, self.epsilon = keys, epsilon
        firsts, slopes, starts, i, n = [], [], [], 0, len(keys)
        while i < n:
            lo, hi, j, step = -np.inf, np.inf, i + 1, 64
            while j < n:
                dx = (keys[j : j + step] - keys[i]).astype(np.float64)
                dy = np.arange(j - i, j - i + len(dx), dtype=np.float64)
                los = np.maximum(lo, np.maximum.accumulate((dy - epsilon) / dx))
                his = np.minimum(hi, np.minimum.accumulate((dy + epsilon) / dx))
                broken = np.flatnonzero(los > his)
                if len(broken):
                    k = int(broken[0])
                    if k:
                        lo, hi = los[k - 1], his[k - 1]
                    j += k
                    break
                lo, hi, j, step = los[-1], his[-1], j + len(dx), step * 2
            firsts.append(keys[i])
            starts.append(i)
            slopes.append(0.0 if not np.isfinite(lo + hi) else (lo + hi) / 2)
            i = j
        self.firsts = np.array(firsts, dtype=np.int64)
        self.starts = np.array(starts + [n], dtype=np.int64)
        self.slopes = np.array(slopes, dtype=np.float64)

    def lower_bound(self, q: np.ndarray) -> np.ndarray:
        """For each query the first position whose key is >= it, as ``searchsorted`` would give."""
        n = len(self.keys)
        piece = np.maximum(np.searchsorted(self.firsts, q, side="right") - 1, 0)
        guess = self.starts[piece] + np.rint(self.slopes[piece] * (q - self.firsts[piece]))
        guess = np.clip(guess, self.starts[piece], self.starts[piece + 1]).astype(np.int64)
        lo = np.clip(guess - self.epsilon - 1, 0, n)
        hi = np.clip(guess + self.epsilon + 2, 0, n)
        # the bound holds for keys; between two keys the prediction is monotone, so it holds up to one position
        while True:
            active = np.flatnonzero(lo < hi)
            if not len(active):
                break
            mid = (lo[active] + hi[active]) >> 1
            less = self.keys[mid] < q[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
        wrong = ((lo > 0) & (self.keys[np.maximum(lo, 1) - 1] >= q)) | ((lo < n) & (self.keys[np.minimum(lo, n - 1)] < q))
        if wrong.any():  # rounding at a piece's edge; exact in any case
            lo[wrong] = np.searchsorted(self.keys, q[wrong])
        return lo


def nearest_in(keys: np.ndarray, ids: np.ndarray, q: np.ndarray, tolerance: int) -> np.ndarray:
    """Position of the nearest key of each query or -1; of two equally near the one with the smaller id."""
    if not len(keys):
        return np.full(len(q), -1, dtype=np.int64)
    at = LearnedIndex(keys).lower_bound(q)
    n = len(keys)
    right, left = np.minimum(at, n - 1), np.maximum(at - 1, 0)
    far = np.iinfo(np.int64).max
    dr = np.where(at < n, keys[right] - q, far)
    dl = np.where(at > 0, q - keys[left], far)
    take_left = (dl < dr) | ((dl == dr) & (ids[left] < ids[right]))
    best = np.where(take_left, left, right)
    return np.where(np.minimum(dl, dr) <= tolerance, best, -1)


def _match(tolerance: int):
    """Arrow batches sorted by (entity, slice, side, t, id) -> pairs. Only one shard's right side is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, ids = None, [], []
        ready = last = None
        for b in batches:
            if not b.num_rows:
                continue
            entity = b.column("entity").to_pylist()
            slice_ = b.column("slice").to_numpy()
            side = b.column("side").to_numpy()
            t, rid = b.column("t").to_numpy(), b.column("id").to_numpy()
            codes = pa.array(entity).dictionary_encode().indices.to_numpy()
            change = (codes[1:] != codes[:-1]) | (slice_[1:] != slice_[:-1]) | (side[1:] != side[:-1])
            cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(t)]))
            out_l, out_r = [], []
            for a, z in zip(cuts[:-1], cuts[1:]):
                here = (entity[a], int(slice_[a]))
                if here != shard:
                    shard, keys, ids, ready = here, [], [], None
                if side[a] == 0:
                    keys.append(t[a:z])
                    ids.append(rid[a:z])
                    ready = None
                    continue
                if ready is None:
                    k = np.concatenate(keys) if keys else np.empty(0, np.int64)
                    i = np.concatenate(ids) if ids else np.empty(0, np.int64)
                    first = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
                    ready = (k[first], i[first])  # of one time only the smallest id can be an answer
                fresh = np.concatenate(([last != (here, t[a], rid[a])], (t[a + 1 : z] != t[a : z - 1]) | (rid[a + 1 : z] != rid[a : z - 1])))
                last = (here, t[z - 1], rid[z - 1])  # a record delivered again is the next row
                pos = nearest_in(*ready, t[a:z], tolerance)
                hit = np.flatnonzero((pos >= 0) & fresh)
                out_l.append(rid[a:z][hit])
                out_r.append(ready[1][pos[hit]])
            if out_l and sum(map(len, out_l)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_l, out_r)], ["left_id", "right_id"])

    return run


def nearest_by_time(
    left: DataFrame, right: DataFrame, entity: str, left_id: str, left_t: str, right_id: str, right_t: str,
    tolerance: int, shard_width: int = SHARD_MS,
) -> DataFrame:
    """Rows ``left_id, right_id``: for each left record the right record of the same entity nearest in time.

    Times are integers (ms), ids bigint. Of two equally near records the smaller id is taken; a pair farther apart than
    ``tolerance`` is none. Rows with null entity, id or time on either side take no part; repeated rows count once.
    Other columns, whatever their names, are not read. Empty tables give an empty result.
    """
    if tolerance >= shard_width:
        raise ValueError("the tolerance must be smaller than a shard")

    def side(df: DataFrame, rid: str, t: str, n: int) -> DataFrame:
        x = df.select(df[entity].cast("string").alias("entity"), df[t].cast("bigint").alias("t"), df[rid].cast("bigint").alias("id"))
        x = x.where("entity IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL")
        if n:
            x = x.withColumn("slice", F.floor(F.col("t") / shard_width))
        else:  # a copy in the next shard where an edge is within the tolerance
            a, z = (F.floor((F.col("t") + d) / shard_width) for d in (-tolerance, tolerance))
            x = x.withColumn("slice", F.explode(F.sequence(a, z)))
        return x.select("entity", "slice", F.lit(n).cast("tinyint").alias("side"), "t", "id")

    rows = side(right, right_id, right_t, 0).unionByName(side(left, left_id, left_t, 1))
    rows = rows.repartition("entity", "slice").sortWithinPartitions("entity", "slice", "side", "t", "id")
    return rows.mapInArrow(_match(tolerance), "left_id bigint, right_id bigint")
