"""The k most similar vectors of every vector, from small-world graphs built shard by shard.

Vectors are routed to cells (centroids of a bounded sample). A vector is a member of its nearest cell, whose graph holds
it, and a guest of every cell whose centroid is little farther (``MARGIN``): there it only asks for its neighbours. How
many cells that are depends on the place of the vector, not on a fixed number of probes, so the share of neighbours that
meet does not fall as cells grow in number. Centroids closer than ``MERGED`` cut one voice and are one cell. A cell of
more members than half the capacity is split by hash: every part has its graph, and every two parts are compared vector
by vector, two parts a group, which grows with the square of the cell. Guests come in batches. No group has more rows
than the capacity. The results of all shards are merged by exact rounded cosine. Copies (equal directions) are one node
of a graph, whatever their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parolis.llm.hnsw import BATCH, BREADTH, Graph, best_of, closest
from parolis.runtime import cut_lineage

#: Rows of one group, members and guests; vectors that the centroids are fitted on; superseded rows still broadcast.
CAPACITY, SAMPLE, BROADCAST_ROWS = 16_384, 20_000, 100_000
#: Share of half the capacity that a cell has on average; how much farther than the nearest a cell may be, in deviations
#: of the cosine of random directions (1 / sqrt(dim)).
FILL, MARGIN = 0.6, 1.1
#: Cosine of centroids that are one cell.
MERGED = 0.6

_ROUND = 6


def latest(df: DataFrame, utt_id: str, version: str) -> DataFrame:
    """Rows that no row of the same id with a greater version supersedes; rows with a null id or version are ignored.

    Only ids and versions are shuffled; the vectors stay where they are unless very many rows are superseded.
    """
    rows = df.where(F.col(utt_id).isNotNull() & F.col(version).isNotNull())
    ids = rows.select(F.col(utt_id).alias("id_"), F.col(version).alias("version_"))
    tops = ids.groupBy("id_").agg(F.max("version_").alias("top"), F.count("*").alias("n")).where("n > 1")
    old = cut_lineage(ids.join(tops, "id_").where("version_ < top").select("id_", "version_").distinct())
    if old.count() <= BROADCAST_ROWS:
        old = F.broadcast(old)
    return rows.join(old, (rows[utt_id] == old["id_"]) & (rows[version] == old["version_"]), "left_anti")


def unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of very large, no underflow of very small values
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, cells: int, seed: int = 3, rounds: int = 10) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), cells, replace=len(sample) < cells)].copy()
    for _ in range(rounds):
        at = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def regions(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids in order of their cell and where each cell starts: those linked by cosines of ``MERGED`` are one."""
    near = c @ c.T >= MERGED
    cell = np.arange(len(c))
    while True:
        least = np.where(near, cell, len(c)).min(axis=1)
        least = np.minimum(least, cell)
        if (least == cell).all():
            break
        cell = least
    order = np.argsort(cell, kind="stable")
    return c[order], np.flatnonzero(np.concatenate(([True], np.diff(cell[order]) > 0)))


def _route(shared, dim: int, with_vectors: bool):
    """Rows -> a row a cell, ``role`` 0 for the member and 2 for a guest; or their numbers alone."""

    def run(batches):
        c, starts = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                s = np.maximum.reduceat(unit_rows(part.column("v"), dim) @ c.T, starts, axis=1)
                home = s.argmax(axis=1)
                near = s >= s[np.arange(len(s)), home][:, None] - MARGIN / math.sqrt(dim)
                row, cell = np.nonzero(near)
                role = np.where(cell == home[row], 0, 2)
                if not with_vectors:
                    found, n = np.unique(cell * 4 + role, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((found // 4).astype(np.int32)), pa.array((found % 4).astype(np.int32)), pa.array(n)], ["cell", "role", "n"])
                    continue
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(role.astype(np.int32)), part.column("id").take(take), part.column("v").take(take)], ["cell", "role", "id", "v"]
                )

    return run


class _Nodes:
    """Rows with equal directions as one node; the members of a node come in order of position."""

    def __init__(self, unit: np.ndarray, at: np.ndarray):
        grid = np.ascontiguousarray((unit[at] * 2**20).round().astype(np.int32))
        _, rep, self.node = np.unique(grid.view(f"V{grid.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
        self.member, self.unit = at, unit[at[rep]]
        self.by_node = np.argsort(self.node, kind="stable")
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(self.node, minlength=len(rep)))))

    def _each(self, nodes: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        n = self.starts[nodes + 1] - self.starts[nodes]
        n = n if most is None else np.minimum(n, most)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return n, self.member[self.by_node[np.repeat(self.starts[nodes], n) + at]]

    def into(self, src: np.ndarray, nodes: np.ndarray, cos: np.ndarray, k: int) -> tuple:
        """Edges to nodes as edges to their first ``k + 1`` members; more can never be among ``k``."""
        n, to = self._each(nodes, k + 1)
        return np.repeat(src, n), to, np.repeat(cos, n)

    def leaving(self, nodes: np.ndarray, to: np.ndarray, cos: np.ndarray) -> tuple:
        """Edges between nodes hold for each member of the node they leave."""
        n, src = self._each(nodes, None)
        return src, np.repeat(to, n), np.repeat(cos, n)


def _across(one: _Nodes, other: _Nodes, k: int, least: float) -> tuple:
    """Edges from the rows of ``one`` to their most similar rows of ``other``; all are compared."""
    base, out = other.unit.astype(np.float32), []
    for at in range(0, len(one.unit), BATCH):
        q = one.unit[at : at + BATCH]
        ids, sims = closest(q.astype(np.float32), base, BREADTH)
        row, to, cos = best_of(q, other.unit, ids, sims, k, least, _ROUND)
        out.append((row + at, to, cos))
    return other.into(*one.leaving(*(np.concatenate(x) for x in zip(*out))), k)


#: Roles of the rows of a group: a member, a member of the other part, a guest, a guest that is compared in full.
MEMBER, OTHER, GUEST, LATE = range(4)


def shard_pairs(ids: np.ndarray, unit: np.ndarray, role: np.ndarray, k: int, least: float) -> tuple:
    """(from, to, cosine) positions: for each row its ``k`` most similar rows, ties by smaller id.

    Members ask among themselves and guests among the members. With members of another part only pairs across are
    looked for."""
    order = np.lexsort((role, ids))
    keep = np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (role[order][1:] != role[order][:-1])))
    order = order[keep]  # an id given again counts once
    unit, role = unit[order], role[order]
    here, other, guest, late = (np.flatnonzero(role == r) for r in (MEMBER, OTHER, GUEST, LATE))
    nothing = (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    if not len(here):
        return nothing
    own, parts = _Nodes(unit, here), [nothing]
    if len(other):
        others = _Nodes(unit, other)
        parts += [_across(own, others, k, least), _across(others, own, k, least)]
    elif len(late):
        parts.append(_across(_Nodes(unit, late), own, k, least))
    else:
        graph = Graph(own.unit)
        parts.append(own.into(*own.leaving(*graph.neighbours(k, least, _ROUND)), k))
        twin = np.flatnonzero(np.diff(own.starts)[own.node] > 1)
        if least <= 1 and len(twin):
            parts.append(own.into(here[twin], own.node[twin], np.ones(len(twin)), k))
        if len(guest):
            asking = _Nodes(unit, guest)
            parts.append(own.into(*asking.leaving(*graph.search(asking.unit, k, least, _ROUND)), k))
    src, to, cos = (np.concatenate(x) for x in zip(*parts))
    other = src != to
    src, to, cos = src[other], to[other], cos[other]
    by = np.lexsort((to, -cos, src))  # positions are in order of id
    src, to, cos = src[by], to[by], cos[by]
    if len(src):
        fresh = np.concatenate(([True], src[1:] != src[:-1]))
        rank = np.arange(len(src)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        src, to, cos = src[rank < k], to[rank < k], cos[rank < k]
    return order[src], order[to], cos


def _shard(dim: int, k: int, least: float):
    def run(t: pa.Table) -> pa.Table:
        ids = np.asarray(t.column("id").to_pylist(), dtype=object)
        src, to, cos = shard_pairs(ids, unit_rows(t.column("v"), dim), t.column("role").to_numpy(), k, least)
        names = t.column("id").combine_chunks()
        return pa.table({"a": names.take(pa.array(src)), "b": names.take(pa.array(to)), "cos": pa.array(cos)})

    return run


def _parts(sizes: dict[tuple[int, int], int], capacity: int) -> dict[int, tuple[int, int]]:
    """Parts of the members (half the capacity at most) and batches of the guests (what a part leaves) of each cell."""
    out = {}
    for (c, role), n in sizes.items():
        if role == MEMBER:
            p = math.ceil(n / max(1, capacity // 2))
            out[c] = p, max(1, math.ceil(sizes.get((c, GUEST), 0) / max(1, capacity - math.ceil(n / p))))
    return out


def grouped(rows: DataFrame, sizes: dict[tuple[int, int], int], capacity: int) -> DataFrame:
    """Routed rows with the groups (``cell, part, other``) they stand in, none of more than about ``capacity`` rows.

    A cell of ``p`` parts has a group a part (``part = other``) with the first batch of guests, one for every two parts,
    and one for each part and further batch of guests (``other >= p``).
    """
    many = {c: x for c, x in _parts(sizes, capacity).items() if x != (1, 1)}  # at most the number of vectors over half the capacity
    if not many:
        return rows.withColumn("part", F.lit(0)).withColumn("other", F.lit(0))

    def of(i: int):
        return F.coalesce(F.element_at(F.create_map(*[F.lit(y) for c, x in many.items() for y in (c, x[i])]), F.col("cell")), F.lit(1))

    rows = rows.withColumn("p", of(0)).withColumn("b", of(1)).withColumn("h", F.xxhash64("id"))
    member = F.col("role") == MEMBER
    rows = rows.withColumn("slot", F.when(member, F.pmod("h", F.col("p"))).otherwise(F.pmod("h", F.col("b"))).cast("int"))
    # members meet every part and every later batch; guests every part
    last = F.when(member, F.col("p") + F.col("b") - 2).otherwise(F.col("p") - 1)
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), last)))
    later = F.col("p") + F.col("slot") - 1
    part = F.when(~member, F.col("x")).when(F.col("x") < F.col("p"), F.least("slot", "x")).otherwise(F.col("slot"))
    other = F.when(~member & (F.col("slot") == 0), F.col("x")).when(~member, later).when(F.col("x") < F.col("p"), F.greatest("slot", "x")).otherwise(F.col("x"))
    role = F.when(member & (F.col("x") < F.col("slot")), OTHER).when(~member & (F.col("slot") > 0), LATE).otherwise(F.col("role"))
    return rows.select("cell", part.alias("part"), other.alias("other"), role.alias("role"), "id", "v")


def nearest_vectors(
    df: DataFrame, utt_id: str = "utt_id", vector: str = "v", version: str = "line_no", dim: int = 192, k: int = 5,
    least: float = 0.7, capacity: int = CAPACITY,
) -> DataFrame:
    """Rows ``a, b, cos``: ``b`` is among the ``k`` most similar of ``a`` and the cosine, rounded to 6 places, is at
    least ``least``; of equal cosines the smaller id goes first. Approximate above and exact in what it reports.

    Of rows with one id the greatest version counts. Vectors that are null, of another length, with a null, NaN or
    infinite value, or all zero take no part, and the row they supersede does not return. Null ids and versions are
    ignored. Other columns are not read. Empty tables give an empty result.
    """
    spark = df.sparkSession
    rows = df.select(df[utt_id].cast("string").alias("id"), df[version].cast("bigint").alias("line"), df[vector].cast("array<float>").alias("v"))
    rows = latest(rows, "id", "line")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0)).select("id", "v")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "a string, b string, cos double")
    cells = math.ceil(n / (FILL * max(1, capacity // 2)))
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow()
    shared = spark.sparkContext.broadcast(regions(centroids(unit_rows(sample.column("v"), dim), cells).astype(np.float32)))
    sizes = rows.mapInArrow(_route(shared, dim, False), "cell int, role int, n bigint").groupBy("cell", "role").agg(F.sum("n").alias("n"))
    sizes = {(r.cell, r.role): r.n for r in sizes.collect()}  # two rows a cell
    routed = grouped(rows.mapInArrow(_route(shared, dim, True), "cell int, role int, id string, v array<float>"), sizes, capacity)
    key = ["cell", "part", "other"]
    n_groups = sum((p * (p + 1)) // 2 + p * (b - 1) for p, b in _parts(sizes, capacity).values())
    routed = routed.repartition(n_groups * 4 if n_groups <= 256 else n_groups, *key)  # few groups: hardly two in a task
    found = routed.groupBy(*key).applyInArrow(_shard(dim, k, least), "a string, b string, cos double")
    # a pair seen from one side only counts for the other as well
    both = F.explode(F.array(F.struct("a", "b", "cos"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cos")))
    found = found.select(both.alias("x")).select("x.*").repartition("a").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def similar_pairs(df: DataFrame, **columns) -> DataFrame:
    """Rows ``utt_a, utt_b, cos`` with ``utt_a < utt_b``: one of the two is among the nearest of the other."""
    found = nearest_vectors(df, **columns)
    pairs = found.select(F.least("a", "b").alias("utt_a"), F.greatest("a", "b").alias("utt_b"), "cos")
    return pairs.groupBy("utt_a", "utt_b").agg(F.max("cos").alias("cos"))
