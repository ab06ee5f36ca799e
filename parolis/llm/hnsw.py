"""Hierarchical navigable small-world graph of one shard, as flat neighbour arrays, built and searched in batches on numpy.

Every vector draws a level; level ``l`` holds those that drew ``l`` or more, each with up to ``DEGREE`` neighbours of that
level in two arrays (ids and similarities). A search begins at all vectors of the highest level and descends: on each
level it walks to the best vectors it can reach, which are its entries one level below. A vector that finds nothing as
similar as ``COVER`` on level 1 is raised to it, so that every dense region, however small, can be entered (levels drawn
at random alone leave small regions far from all others without an entry). Searches of a batch run in lockstep: every
step expands the best unexpanded candidates of each query at once. The candidates a search ends with are compared in
full and in double precision; the walk itself goes by a fixed orthogonal projection to fewer dimensions. Inside one region of very many vectors a walk misses neighbours, whatever its entry;
vectors of such regions are compared with all others in matrix products instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Neighbours a vector keeps, neighbours it asks for when inserted, similarity of the cover.
DEGREE, LINKS, COVER = 16, 8, 0.5
#: One vector in so many reaches the next level; a level of so few is the highest.
RATIO, SUMMIT = 16, 48
#: Candidates that a search keeps at the end, while the graph is built, and on the levels above the base.
BREADTH, BUILD_BREADTH, UPPER_BREADTH = 32, 16, 16
#: Dimensions of the projection, batch of insertions and searches, candidates expanded a step.
PROJECTED, BATCH, BEAM = 96, 512, 4

#: Vectors under one entry of the cover from which on the region is dense.
DENSE = 700
#: Columns of a product that are reduced to their maximum before the best are chosen.
_STRIP = 32

_NONE = np.float32(-9)


def closest(q: np.ndarray, base: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the ``count`` rows of ``base`` most similar to each row of ``q`` (float32), all compared."""
    s = q @ base.T
    pad = -s.shape[1] % _STRIP
    if pad:
        s = np.concatenate([s, np.full((len(s), pad), _NONE, np.float32)], axis=1)
    strips = s.reshape(len(s), -1, _STRIP)
    if strips.shape[1] <= count:
        at = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    else:  # the best stand in the strips with the greatest maxima
        top = np.argpartition(-strips.max(axis=2), count - 1, axis=1)[:, :count]
        at = (top[:, :, None] * _STRIP + np.arange(_STRIP)).reshape(len(s), -1)
    sims = np.take_along_axis(s, at, 1)
    if sims.shape[1] > count:
        keep = np.argpartition(-sims, count - 1, axis=1)[:, :count]
        at, sims = np.take_along_axis(at, keep, 1), np.take_along_axis(sims, keep, 1)
    return np.where(sims > _NONE, at, 0).astype(np.int32), sims


class Graph:
    """Vectors (unit rows) and their flat neighbour arrays."""

    def __init__(self, unit: np.ndarray, seed: int = 5):
        n, d = unit.shape
        rng = np.random.default_rng(seed)
        self.unit = unit
        self.basis = np.linalg.qr(rng.standard_normal((d, d)))[0][:, :PROJECTED].astype(np.float32) if d > PROJECTED else None
        #: How far a navigation similarity may lie below the true one.
        self.slack = 1e-3 if self.basis is None else 0.35
        self.flat = self._project(unit)
        #: Level of each vector (-1: not yet inserted) and neighbour arrays of each level, base first.
        self.level = np.full(n, -1, dtype=np.int8)
        self.height = 1
        while n > SUMMIT * RATIO**self.height:
            self.height += 1
        self.links = [np.full((n, DEGREE), -1, dtype=np.int32) for _ in range(self.height + 1)]
        self.sims = [np.full((n, DEGREE), _NONE, dtype=np.float32) for _ in range(self.height + 1)]
        drawn = np.minimum((-np.log(rng.random(n)) / np.log(RATIO)).astype(np.int8), self.height)
        self.summit = np.empty(0, dtype=np.int32)
        self._seen = np.zeros((BATCH, n), dtype=bool)
        order = rng.permutation(n).astype(np.int32)
        at = 0
        while at < n:
            size = min(BATCH, max(64, at // 2), n - at)
            self._insert(order[at : at + size], drawn[order[at : at + size]])
            at += size
        del self._seen

    def _project(self, unit: np.ndarray) -> np.ndarray:
        flat = unit.astype(np.float32)
        if self.basis is not None:
            flat = flat @ self.basis
            flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)
        return np.ascontiguousarray(flat)

    def _nearest_of(self, q: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        s = q @ self.flat[ids].T
        k = min(count, s.shape[1])
        at = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(k), s.shape)
        return ids[at], np.take_along_axis(s, at, 1)

    def _entries(self, q: np.ndarray, seen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Level, ids and similarities found on the levels above the base, downwards."""
        ids, sims = self._nearest_of(q, self.summit, 8)
        for level in range(self.height, 0, -1):
            ids, sims = self._search(q, ids, sims, seen, UPPER_BREADTH, level)
            seen[: len(q)] = False
            yield level, ids, sims

    def _search(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, seen: np.ndarray, breadth: int, level: int = 0) -> tuple:
        """Best ``breadth`` candidates of one level for each row of ``q`` from the given entries."""
        b = len(q)
        rows = np.arange(b)[:, None]
        seen[rows, ids] = True
        pad = max(0, breadth - ids.shape[1])
        ids = np.concatenate([ids, np.zeros((b, pad), np.int32)], axis=1)
        sims = np.concatenate([sims, np.full((b, pad), _NONE, np.float32)], axis=1)
        done = sims == _NONE
        live = np.arange(b)
        while len(live):
            open_sims = np.where(done[live], _NONE, sims[live])
            pick = np.argpartition(-open_sims, BEAM - 1, axis=1)[:, :BEAM]
            value = np.take_along_axis(open_sims, pick, 1)
            going = value.max(axis=1) > _NONE
            live, pick, value = live[going], pick[going], value[going]
            if not len(live):
                break
            done[live[:, None], pick] = True
            nxt = self.links[level][ids[live[:, None], pick]]
            nxt[value == _NONE] = -1
            nxt = np.sort(nxt.reshape(len(live), -1), axis=1)
            nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = -1  # reached from two sides at once
            who, col = np.nonzero(nxt >= 0)
            new = nxt[who, col]
            fresh = ~seen[live[who], new]
            who, col, new = who[fresh], col[fresh], new[fresh]
            seen[live[who], new] = True
            near = np.full(nxt.shape, _NONE, dtype=np.float32)
            near[who, col] = np.einsum("ij,ij->i", self.flat[new], q[live[who]])
            all_ids = np.concatenate([ids[live], nxt], axis=1)
            all_sims = np.concatenate([sims[live], near], axis=1)
            all_done = np.concatenate([done[live], near == _NONE], axis=1)
            keep = np.argpartition(-all_sims, breadth - 1, axis=1)[:, :breadth]
            ids[live] = np.take_along_axis(all_ids, keep, 1)
            sims[live] = np.take_along_axis(all_sims, keep, 1)
            done[live] = np.take_along_axis(all_done, keep, 1)
        return ids, sims

    def _insert(self, new: np.ndarray, drawn: np.ndarray) -> None:
        q = self.flat[new]
        among = q @ q.T
        np.fill_diagonal(among, _NONE)
        found: dict[int, tuple] = {}
        best = np.full(len(new), -1.0, dtype=np.float32)
        if len(self.summit):
            for level, ids, sims in self._entries(q, self._seen):
                found[level] = ids, sims
            best = sims.max(axis=1)
            found[0] = self._search(q, ids[:, :8], sims[:, :8], self._seen, BUILD_BREADTH)
            self._seen[: len(new)] = False
        # raised to level 1: what nothing there resembles
        joined: list[int] = np.flatnonzero(drawn > 0).tolist()
        for i in np.flatnonzero((best < COVER) & (drawn == 0)):
            if not joined or among[i, joined].max() < COVER:
                joined.append(i)
                drawn[i] = 1
        self.level[new] = drawn
        for level in range(min(self.height, int(drawn.max())) + 1):
            mine = np.flatnonzero(drawn >= level)
            self._attach(new[mine], among[np.ix_(mine, mine)], *(x[mine] for x in found[level]) if level in found else (), level=level)
        high = self.height
        while high > 1 and not (self.level == high).any():
            high -= 1
        top = np.flatnonzero(self.level >= high).astype(np.int32)
        self.summit = top if len(top) else new[:1]

    def _attach(self, new: np.ndarray, among: np.ndarray, *found: np.ndarray, level: int) -> None:
        """Links vectors on a level to what their search found there and to each other."""
        b = len(new)
        ids, sims = found if found else (np.empty((b, 0), np.int32), np.empty((b, 0), np.float32))
        k = min(LINKS, b - 1)
        if k > 0:
            at = np.argpartition(-among, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, new[at]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(among, at, 1)], axis=1)
        if not ids.shape[1]:
            return
        k = min(LINKS, ids.shape[1])
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        to, how = np.take_along_axis(ids, at, 1).ravel(), np.take_along_axis(sims, at, 1).ravel()
        src = np.repeat(new, k)
        ok = how > _NONE
        src, to, how = src[ok], to[ok], how[ok]
        if len(src):
            self._link(level, np.concatenate([src, to]), np.concatenate([to, src]), np.concatenate([how, how]))

    def _link(self, level: int, of: np.ndarray, to: np.ndarray, how: np.ndarray) -> None:
        """Adds neighbours; a full list keeps its most similar ones."""
        order = np.lexsort((to, -how, of))
        of, to, how = of[order], to[order], how[order]
        twice = np.concatenate(([False], (of[1:] == of[:-1]) & (to[1:] == to[:-1])))
        of, to, how = of[~twice], to[~twice], how[~twice]
        first = np.concatenate(([True], of[1:] != of[:-1]))
        group = np.cumsum(first) - 1
        rank = np.arange(len(of)) - np.flatnonzero(first)[group]
        few = rank < DEGREE
        of, to, how, group, rank = of[few], to[few], how[few], group[few], rank[few]
        target = of[rank == 0]
        width = int(rank.max()) + 1
        ids = np.full((len(target), DEGREE + width), -1, dtype=np.int32)
        sims = np.full((len(target), DEGREE + width), _NONE, dtype=np.float32)
        ids[:, :DEGREE], sims[:, :DEGREE] = self.links[level][target], self.sims[level][target]
        ids[group, DEGREE + rank], sims[group, DEGREE + rank] = to, how
        keep = np.argpartition(-sims, DEGREE - 1, axis=1)[:, :DEGREE]
        self.links[level][target] = np.take_along_axis(ids, keep, 1)
        self.sims[level][target] = np.take_along_axis(sims, keep, 1)

    def neighbours(self, k: int, least: float, decimals: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every vector its ``k`` most similar others with rounded cosine >= ``least``, as (from, to, cosine).

        More than ``k`` are given where they tie with the k-th, so that the caller can break ties by its own order.
        """
        seen = np.zeros((BATCH, len(self.unit)), dtype=bool)
        out = []
        dense = self._dense()
        full = self.flat if self.basis is None else self.unit.astype(np.float32)
        hot, rest = np.flatnonzero(dense).astype(np.int32), np.flatnonzero(~dense).astype(np.int32)
        for a in range(0, len(hot), BATCH):
            me = hot[a : a + BATCH]
            ids, sims = closest(full[me], full, BREADTH)
            sims[ids == me[:, None]] = _NONE
            row, to, cos = self._best(self.unit[me], ids, sims, k, least, decimals)
            out.append((me[row], to, cos))
        for a in range(0, len(rest), BATCH):
            me = rest[a : a + BATCH]
            start = np.concatenate([me[:, None], self.links[0][me]], axis=1)
            sims = np.concatenate([np.ones((len(me), 1), np.float32), self.sims[0][me]], axis=1)
            start = np.where(start < 0, me[:, None], start)
            ids, sims = self._search(self.flat[me], start, sims, seen, BREADTH)
            seen[: len(me)] = False
            sims[ids == me[:, None]] = _NONE
            row, to, cos = self._best(self.unit[me], ids, sims, k, least, decimals)
            out.append((me[row], to, cos))
        return self._joined(out)

    def search(self, unit: np.ndarray, k: int, least: float, decimals: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for vectors from outside, as (position in ``unit``, to, cosine)."""
        seen = np.zeros((BATCH, len(self.unit)), dtype=bool)
        flat, out = self._project(unit), []
        for a in range(0, len(unit), BATCH):
            q = flat[a : a + BATCH]
            for _, ids, sims in self._entries(q, seen):
                pass
            ids, sims = self._search(q, ids, sims, seen, BREADTH)
            seen[: len(q)] = False
            row, to, cos = self._best(unit[a : a + BATCH], ids, sims, k, least, decimals)
            out.append((row + a, to, cos))
        return self._joined(out)

    def _dense(self) -> np.ndarray:
        """Whether a vector's nearest vector of level 1 is the nearest of ``DENSE`` vectors or more, or such a vector's."""
        upper = np.flatnonzero(self.level >= 1)
        if not len(upper):
            return np.zeros(len(self.flat), dtype=bool)
        region = np.arange(len(upper))  # vectors of level 1 within the cover of each other are one region
        for a in range(0, len(upper), BATCH):
            near = self.flat[upper[a : a + BATCH]] @ self.flat[upper].T >= COVER
            for i in range(len(near)):
                least = region[near[i]].min()
                region[near[i]] = np.minimum(region[near[i]], least)
                region[a + i] = min(region[a + i], least)
        at = [(self.flat[a : a + BATCH] @ self.flat[upper].T).argmax(axis=1) for a in range(0, len(self.flat), BATCH)]
        at = region[np.concatenate(at)]
        return np.bincount(at, minlength=len(upper))[at] >= DENSE

    @staticmethod
    def _joined(parts: list) -> tuple:
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _best(self, unit: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int, least: float, decimals: int) -> tuple:
        return best_of(unit, self.unit, ids, sims, k, least, decimals, self.slack)


def best_of(unit: np.ndarray, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int, least: float, decimals: int, slack: float = 1e-3) -> tuple:
    """Candidates compared in double precision: the best ``k`` of each row and those that tie with the last."""
    row, col = np.nonzero(sims > max(_NONE, least - slack))
    to = ids[row, col]
    cos = np.einsum("ij,ij->i", unit[row], base[to]).round(decimals)
    ok = cos >= least
    row, to, cos = row[ok], to[ok], cos[ok]
    if not len(row):
        return row, to, cos
    order = np.lexsort((to, -cos, row))
    row, to, cos = row[order], to[order], cos[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    begin = first[np.cumsum(np.concatenate(([True], row[1:] != row[:-1]))) - 1]
    kth = np.minimum(begin + k - 1, len(row) - 1)
    keep = (np.arange(len(row)) - begin < k) | ((row[kth] == row) & (cos[kth] == cos))
    return row[keep], to[keep], cos[keep]
