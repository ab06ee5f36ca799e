"""Links between profiles above the reference's threshold, for clusters, reciprocity and triads of all conversations.

The pairs of a left block of profiles are formed, compared and kept as bits by the task that holds the block; similarities are
never shuffled. Input is ``key, v, w``: a discussion (once), its profile and its threshold, NaN where it has none. A link
``ref -> target`` exists where the cosine, rounded to 6 decimals, exceeds the threshold of ``ref``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parolis.operators import blocks

#: Profiles of one block; half a unit of the sixth decimal; rows and bytes of strings of one batch.
BLOCK, HALF, ROWS, BYTES = 1024, 5e-7, 100_000, 8 << 20
#: Middle nodes tried at a time by a product, and the part of the pairs below which single pairs are looked at.
CHUNK, FEW = 256, 0.02


def pack(profiles: DataFrame) -> DataFrame:
    rows = profiles.select(F.col("key").cast("string").alias("key"), F.col("v").cast("array<double>").alias("v"), F.col("w").cast("double").alias("w"))
    return blocks.packed(rows, BLOCK)


class _Linked:
    """Bits of the links of a left block, over all right blocks in order of ``at``: ``out`` from its rows, ``back`` to them."""

    def __init__(self, left) -> None:
        self.at, self.keys, self.u, self.w = left.at, left.strings(), blocks.unit(left.x()), left.numbers("w") + HALF
        self.parts: dict = {}

    def see(self, right):
        s = self.u @ blocks.unit(right.x()).T
        out, back = s >= self.w[:, None], s >= (right.numbers("w") + HALF)[None, :]
        if right.at == self.at:
            np.fill_diagonal(out, False)
            np.fill_diagonal(back, False)
        self.parts[right.at] = right.strings(), np.packbits(out, axis=1), np.packbits(back, axis=1)
        return ()

    def names(self) -> np.ndarray:
        return np.concatenate([self.parts[at][0] for at in sorted(self.parts)])

    def rows(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        order = [self.parts[at] for at in sorted(self.parts)]
        bits = lambda k: np.concatenate([np.unpackbits(p[k][i:j], axis=1, count=len(p[0])) for p in order], axis=1).astype(bool)
        return bits(1), bits(2)


def _joined(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes; ``text`` is the column of long strings."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[text]) + 64
        if size > BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def clusters(profiles: DataFrame) -> DataFrame:
    """``ref, threshold, n_members, members`` of every profile with a threshold, members in order joined by commas."""
    schema = pa.schema([("ref", pa.string()), ("threshold", pa.float64()), ("n_members", pa.int64()), ("members", pa.string())])

    class Visitor(_Linked):
        def end(self):
            names = self.names()
            order = np.argsort(names.astype(str), kind="stable")
            names = names[order]

            def rows():
                for i in range(0, len(self.keys), 64):
                    for k, found in enumerate(self.rows(i, i + 64)[0][:, order], i):
                        if not np.isnan(self.w[k]):
                            at = np.flatnonzero(found)
                            yield self.keys[k], self.w[k] - HALF, len(at), ",".join(names[at])

            yield from _joined(rows(), schema, 3)

    x = pack(profiles)
    out = blocks.meet(x, x, 1, Visitor, "ref string, threshold double, n_members bigint, members string")
    return out.withColumn("threshold", F.round("threshold", 6) + F.lit(0.0))


def _flat(ref: np.ndarray, names: pa.Array, found: np.ndarray, name: str, value, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    a, b = np.nonzero(found)
    for i in range(0, len(a), ROWS):
        r, t = a[i : i + ROWS], b[i : i + ROWS]
        yield pa.RecordBatch.from_pydict({"ref": pa.array(ref, pa.string()).take(pa.array(r)), "target": names.take(pa.array(t)), name: pa.array(value[r, t], kind)})


def reciprocity(profiles: DataFrame) -> DataFrame:
    """``ref, target, reciprocal``."""

    class Visitor(_Linked):
        def see(self, right):
            super().see(right)
            names, out, back = self.parts.pop(right.at)
            n = len(names)
            out, back = (np.unpackbits(x, axis=1, count=n).astype(bool) for x in (out, back))
            yield from _flat(self.keys, pa.array(names, pa.string()), out, "reciprocal", back, pa.bool_())

        def end(self):
            return ()

    x = pack(profiles)
    return blocks.meet(x, x, 1, Visitor, "ref string, target string, reciprocal boolean")


def _bits(profiles: DataFrame) -> DataFrame:
    """One row a block: ``at, start`` (place of its first row among all), ``n, keys`` and the packed rows ``o`` and ``b``,
    checkpointed: twice a bit for every pair of profiles."""

    class Visitor(_Linked):
        def end(self):
            ats = sorted(self.parts)
            start = sum(len(self.parts[at][0]) for at in ats if at < self.at)
            step = [self.rows(i, i + 64) for i in range(0, len(self.keys), 64)]
            o, b = (np.concatenate([np.packbits(x[k], axis=1) for x in step]).tobytes() for k in (0, 1))
            yield pa.RecordBatch.from_pydict({"at": pa.array([self.at], pa.int64()), "start": pa.array([start], pa.int64()), "n": pa.array([len(self.keys)], pa.int32()), "keys": pa.array([list(self.keys)], pa.list_(pa.string())), "o": pa.array([o], pa.binary()), "b": pa.array([b], pa.binary())})

    x = pack(profiles)
    return blocks.cut_lineage(blocks.meet(x, x, 1, Visitor, "at bigint, start bigint, n int, keys array<string>, o binary, b binary"))


def _part(bits: np.ndarray, i: int, n: int) -> np.ndarray:
    """Columns ``i`` to ``i + n`` of packed rows."""
    return np.unpackbits(bits[:, i // 8 : (i + n + 7) // 8], axis=1)[:, i % 8 : i % 8 + n].astype(bool)


def middle(out: np.ndarray, back: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Of the ``asked`` pairs (left row, right row) those with a node that the left links to and that links to the right."""
    found, open_ = np.zeros(asked.shape, dtype=bool), asked.copy()
    at, width = 0, out.shape[1] * 8
    while at < width and open_.mean() > FEW:
        n = min(CHUNK, width - at)
        found |= (_part(out, at, n).astype(np.float32) @ _part(back, at, n).astype(np.float32).T > 0.5) & asked
        open_, at = asked & ~found, at + n
    r, c = np.nonzero(open_) if at < width else ((), ())
    step = max(1, (16 << 20) // out.shape[1])
    for i in range(0, len(r), step):
        rr, cc = r[i : i + step], c[i : i + step]
        found[rr, cc] = (out[rr] & back[cc]).any(axis=1)
    return found


class _Levels:
    """``levels(right)`` of a left block: names of the right block and a matrix of 0 (no link) to 3, as ``graph.LEVELS``."""

    def __init__(self, left) -> None:
        self.keys, self.start = left.strings(), left.number("start")
        self.out, self.back = (left.numbers(c, np.uint8).reshape(len(self.keys), -1) for c in "ob")

    def levels(self, right) -> tuple[np.ndarray, np.ndarray]:
        start, n = right.number("start"), right.number("n")
        out, back = _part(self.out, start, n), _part(self.back, start, n)
        both = out & back
        triad = middle(self.out, right.numbers("b", np.uint8).reshape(n, -1), both)
        return right.strings(), np.where(triad, 3, np.where(both, 1, np.where(out, 2, 0))).astype(np.uint8)


def levels(profiles: DataFrame) -> DataFrame:
    """``ref, target, level`` as ``graph.with_levels``."""

    class Visitor(_Levels):
        def see(self, right):
            names, level = self.levels(right)
            yield from _flat(self.keys, pa.array(names, pa.string()), level > 0, "level", level, pa.int32())

        def end(self):
            return ()

    x = _bits(profiles)
    return blocks.meet(x, x.select("at", "start", "n", "keys", "b"), 1, Visitor, "ref string, target string, level int")


def level_counts(profiles: DataFrame) -> DataFrame:
    """``graph.level_counts`` of all profiles, without a row a link."""

    class Visitor(_Levels):
        def __init__(self, left) -> None:
            super().__init__(left)
            self.n = np.zeros((3, len(self.keys)), dtype=np.int64)

        def see(self, right):
            level = self.levels(right)[1]
            self.n += [(level == k).sum(axis=1) for k in (1, 2, 3)]
            return ()

        def end(self):
            has = self.n.sum(axis=0) > 0
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[has], pa.string()), *(pa.array(x[has]) for x in self.n)], ["ref", "n_reciprocal", "n_dominant", "n_triad"])

    x = _bits(profiles)
    return blocks.meet(x, x.select("at", "start", "n", "keys", "b"), 1, Visitor, "ref string, n_reciprocal bigint, n_dominant bigint, n_triad bigint")


def sparse_matrix(profiles: DataFrame) -> DataFrame:
    """``graph.sparse_matrix`` of all profiles, without a row a link."""
    schema = pa.schema([("ref", pa.string()), ("row", pa.string())])

    class Visitor(_Levels):
        def __init__(self, left) -> None:
            super().__init__(left)
            self.parts: list = []

        def see(self, right):
            self.parts.append(self.levels(right))
            return ()

        def end(self):
            names = np.concatenate([p[0] for p in self.parts])
            order = np.argsort(names.astype(str), kind="stable")
            cells = np.array([[f"{n}={k}" for n in names[order]] for k in (1, 2, 3)], dtype=object)
            level = np.concatenate([p[1] for p in self.parts], axis=1)

            def rows():
                for k, own in enumerate(level):
                    own = own[order]
                    at = np.flatnonzero(own)
                    if len(at):
                        yield self.keys[k], ",".join(cells[own[at] - 1, at])

            yield from _joined(rows(), schema, 1)

    x = _bits(profiles)
    return blocks.meet(x, x.select("at", "start", "n", "keys", "b"), 1, Visitor, "ref string, row string")
