"""All pairs of rows in blocks, without a shuffle of the pairs.

Rows are packed, one row a block, and checkpointed: about once the bytes of the vectors. A Cartesian product then hands every
block to each block on its left; a task holds one left block and sees the right ones one after the other. Nothing is collected
or broadcast, and what a task says of a left block needs no second shuffle where the right side is one partition.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parolis.functions import vec
from parolis.runtime import cut_lineage, ensure_checkpoint_dir

#: Vectors of one block, and rows and columns of one product inside a pair of blocks.
BLOCK, TILE = 8192, 2048
#: Left blocks that are wanted at least, so that all cores work; vectors that one right partition of ``meet``, held in memory, may have
#: (``streamed`` has no such limit).
TASKS, RIGHT = 24, 400_000
#: Vectors of a block that is streamed, and about so many that a task holds as its own.
STREAM, OWN = 2048, 16_384


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, in the type they have."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vec.EPS)


def block_size(n: int, most: int = BLOCK) -> int:
    return int(min(most, max(64, -(-n // TASKS))))


def grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Tables of whole groups of equal ``by`` out of batches in its order."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        names = np.asarray(t.column(by).to_pylist(), dtype=object)
        last = int(np.flatnonzero(names == names[-1])[0])
        if last or (held and held[-1].column(by)[-1].as_py() != names[0]):
            first = last or 0
            done = [*held, t.slice(0, first)] if first else held
            yield pa.concat_tables(done).combine_chunks()
            held = [t.slice(first)]
        else:
            held.append(t)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def by_group(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """Rows of a group together and in order, by one exchange."""
    return rows.repartition(by).sortWithinPartitions(by, *order)


def packed(rows: DataFrame, block: int) -> DataFrame:
    """Rows ``key, v`` (and ``w``, a double) as one row a block: ``at, n, keys, x`` (and ``w``), checkpointed."""
    extra = [c for c in ("w",) if c in rows.columns]
    kind = dict(rows.dtypes)["v"].removeprefix("array<").rstrip(">")
    if kind not in ("float", "double"):
        raise ValueError(f"vectors of {kind}")
    schema = "at bigint, n int, keys array<string>, x binary" + ", w binary" * bool(extra)

    def row(at: int, t: pa.Table) -> pa.RecordBatch:
        out = {"at": pa.array([at], pa.int64()), "n": pa.array([t.num_rows], pa.int32()), "keys": pa.array([t.column("key").to_pylist()], pa.list_(pa.string()))}
        out["x"] = pa.array([matrix(t.column("v")).tobytes()], pa.binary())
        if extra:
            out["w"] = pa.array([t.column("w").to_numpy().astype(np.float64).tobytes()], pa.binary())
        return pa.RecordBatch.from_pydict(out)

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        held, n = [], 0
        pieces = (t.slice(i, block) for b in batches for t in [pa.Table.from_batches([b])] for i in range(0, b.num_rows, block))
        for t in pieces:
            if n + t.num_rows > block:
                held.append(t.slice(0, block - n))
                yield row(at, pa.concat_tables(held))
                at, held, n = at + 1, [t.slice(block - n)], n + t.num_rows - block
                continue
            held, n = [*held, t], n + t.num_rows
        if n:
            yield row(at, pa.concat_tables(held))

    return cut_lineage(rows.select("key", "v", *extra).mapInArrow(run, schema).repartition(TASKS))


def _groups(t: pa.Table, by: str) -> Iterator[pa.Table]:
    names = np.asarray(t.column(by).to_pylist(), dtype=object)
    cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
    for i, j in zip(cuts, cuts[1:]):
        yield t.slice(i, j - i)


class Block:
    """A block as a task sees it; ``x`` is read when asked for."""

    def __init__(self, batch: pa.RecordBatch, i: int, side: str, kind: type) -> None:
        self._get = lambda c: batch.column(f"{side}_{c}")[i]
        self.at, self.kind = self._get("at").as_py(), kind

    def strings(self, name: str = "keys") -> np.ndarray:
        return np.asarray(self._get(name).values.to_pylist(), dtype=object)

    def numbers(self, name: str, kind: type | None = None) -> np.ndarray:
        return np.frombuffer(self._get(name).as_buffer(), dtype=kind or self.kind)

    def number(self, name: str):
        return self._get(name).as_py()

    def x(self) -> np.ndarray:
        return self.numbers("x").reshape(self._get("n").as_py(), -1)


def meet(left: DataFrame, right: DataFrame, right_parts: int, visitor: Callable, schema: str, kind: type = np.float64) -> DataFrame:
    """Every left block with all right ones of a partition: ``visitor(block)`` makes an object whose ``see(block)`` and ``end()``
    yield batches of ``schema``."""

    def run(batches):
        now, v = None, None
        for b in batches:
            ats = b.column("l_at").to_pylist()
            for i, at in enumerate(ats):
                if at != now:
                    if v is not None:
                        yield from v.end()
                    now, v = at, visitor(Block(b, i, "l", kind))
                yield from v.see(Block(b, i, "r", kind))
        if v is not None:
            yield from v.end()

    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).coalesce(right_parts)
    return a.crossJoin(b.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def streamed(rows: DataFrame, block: int, visitor: Callable, schema: str, whole: bool = False, unpack: Callable | None = None) -> DataFrame:
    """Rows ``key, v`` in groups, each of which meets all rows: ``visitor(keys, x)`` makes an object of a group's rows whose
    ``see(keys, x)`` takes a block, and whose ``end()`` yields batches of ``schema``.

    Blocks are checkpointed once, without a shuffle. A task reads them twice, one at a time: it keeps those of its own group,
    then sees all. So its memory holds ``OWN`` rows and one block, however many there are, and no result is in parts.

    With ``whole`` the rows come in order of ``key``, no block ends inside a value of it, and of two groups only one sees the
    other's blocks; what a group has to say of itself is up to its ``end()``. ``see(keys, x)`` may yield too. With ``unpack``
    the visitor yields what ``unpack`` makes batches of, so that it may send less than the rows.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext

    def pack(batches):
        at, held, n = TaskContext.get().partitionId() << 32, [], 0

        def row():
            t = pa.concat_tables(held)
            body = pickle.dumps((t.column("key").to_pylist(), matrix(t.column("v"))), 5)
            return pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "n": pa.array([n], pa.int32()), "body": pa.array([body], pa.binary())})

        for t in (p for g in grouped(batches, "key") for p in _groups(g, "key")) if whole else map(lambda b: pa.Table.from_batches([b]), batches):
            if whole:
                if n and n + t.num_rows > block:
                    yield row()
                    at, held, n = at + 1, [], 0
                held, n = [*held, t], n + t.num_rows
                continue
            while t.num_rows:
                some = t.slice(0, block - n)
                held, n, t = [*held, some], n + some.num_rows, t.slice(block - n)
                if n == block:
                    yield row()
                    at, held, n = at + 1, [], 0
        if n:
            yield row()

    def sent(found):
        for b in found or ():
            if unpack:
                yield (pickle.dumps(b, 5),)
                continue
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield (sink.getvalue().to_pybytes(),)

    def run(pairs):
        held, v = [], None
        for (wanted, met), (at, _, body) in pairs:
            if met and v is None:
                v = visitor([k for keys, _ in held for k in keys], np.concatenate([x for _, x in held]))
                held = []
            if wanted is not None and at not in wanted:
                continue
            if met:
                yield from sent(v.see(*pickle.loads(body)))
            else:
                held.append(pickle.loads(body))
        if v is not None:
            yield from sent(v.end())

    def read(batches):
        for b in batches:
            for x in b.column("b"):
                yield from unpack(pickle.loads(x.as_buffer())) if unpack else pa.ipc.open_stream(x.as_buffer())

    ensure_checkpoint_dir(spark)
    packs = rows.select("key", "v").mapInArrow(pack, "at bigint, n int, body binary").rdd.map(lambda r: (r.at, r.n, bytes(r.body)))
    packs.checkpoint()
    packs._jrdd.rdd().doCheckpoint()  # at once; an action would compute the rows first and then again
    sizes = sorted(packs.map(lambda p: p[:2]).collect(), key=lambda p: (-p[1], p[0]))
    count = min(len(sizes), max(TASKS, -(-sum(n for _, n in sizes) // OWN)))
    groups = [(0, g, set()) for g in range(count)]  # by rows, so that all tasks have about as many
    for at, n in sizes:
        held, g, own = groups[0]
        own.add(at)
        heapq.heapreplace(groups, (held + n, g, own))
    owns = [own for _, _, own in groups]
    others = [set().union(*(owns[h] for h in half(g, count))) for g in range(count)] if whole else [None] * count
    passes = [p for own, other in zip(owns, others) for p in ((own, False), (other, True))]
    # one a batch, as the product hands on whole batches
    left = sc.parallelize(passes, max(1, count))._reserialize(BatchedSerializer(CPickleSerializer(), 1))
    out = left.cartesian(packs.coalesce(1)).mapPartitions(run)
    return spark.createDataFrame(out, "b binary", verifySchema=False).mapInArrow(read, schema)


def half(g: int, count: int) -> list[int]:
    """Of ``count`` in a circle those that ``g`` meets, so that any two meet once and all have about as many."""
    return [(g + d) % count for d in range(1, count // 2 + 1) if 2 * d < count or g < count // 2]
