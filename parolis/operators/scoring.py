"""Speaker search: raw cosine and cohort-normalised scores of one enrolled vector against a corpus.

The cohort of impostors is the corpus without the enrolled id. What a normalisation needs of it is computed once per
vector, never once per comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parolis.functions import vec
from parolis.operators import blocks
from parolis.runtime import cut_lineage

#: Default thresholds of a decision, cohort size.
THRESHOLDS = {"cosine": 0.75, "snorm": 2.0, "asnorm": 2.0, "adnorm": 0.75}
COHORT = 100
#: Groups in which tasks' moments are added up. Adaptive threshold: floor, factor of the deviation, number of scores it needs, value without them.
_GROUPS = 64
FLOOR, FACTOR, ENOUGH, FALLBACK = 0.45, 0.5, 5, 0.50


def _cohort_stats(corpus: DataFrame, ref_id: str) -> DataFrame:
    """Mean and sample deviation of each vector's cosines with all impostors: ``utt_id, mu, sigma, n``.

    They follow from the impostors' mean ``m`` and second moments ``G`` (``d x d``): a vector's cosines have mean ``u.m``
    and mean square ``u.G.u``. So the cost is linear in the vectors; tasks send one row each, added up in a few groups.
    """

    def unit_rows(column) -> np.ndarray:
        x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vec.EPS)

    def moments(batches):
        n, s, g = 0, 0.0, 0.0
        for b in batches:
            pick = b.filter(pc.not_equal(b.column("utt_id"), ref_id))
            if pick.num_rows:
                u = unit_rows(pick.column("v"))
                n, s, g = n + len(u), s + u.sum(axis=0), g + u.T @ u
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array([hash((n, float(s[0]))) % _GROUPS], pa.int32()), "n": pa.array([n], pa.int64()), "x": pa.array([np.concatenate([s, g.ravel()])], pa.list_(pa.float64()))})

    def added(t: pa.Table) -> pa.Table:
        x = np.asarray(t.column("x").combine_chunks().flatten()).reshape(t.num_rows, -1).sum(axis=0)
        return pa.table({"n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "x": pa.array([x], pa.list_(pa.float64()))})

    parts = corpus.select("utt_id", "v").mapInArrow(moments, "at int, n bigint, x array<double>")
    parts = parts.groupBy("at").applyInArrow(added, "n bigint, x array<double>").collect()  # _GROUPS rows at most
    n = sum(r.n for r in parts)
    x = sum((np.asarray(r.x) for r in parts), np.zeros(1))
    d = int((np.sqrt(4 * len(x) + 1) - 1) // 2)
    m, g = x[:d] / max(1, n), x[d:].reshape(d, -1) / max(1, n) if n else np.zeros((0, 0))

    def scored(batches):
        for b in batches:
            u = unit_rows(b.column("v"))
            mu = u @ m if n else np.full(len(u), np.nan)
            var = np.maximum(((u @ g) * u).sum(axis=1) - mu**2, 0.0) * n / (n - 1) if n > 1 else np.full(len(u), np.nan)
            sigma = pa.array(np.sqrt(var), from_pandas=True)
            yield pa.RecordBatch.from_arrays([b.column("utt_id"), pa.array(mu, from_pandas=True), sigma, pa.array(np.full(len(u), n))], ["utt_id", "mu", "sigma", "n"])

    return corpus.select("utt_id", "v").mapInArrow(scored, "utt_id string, mu double, sigma double, n bigint")


class _Nearest:
    """The ``k`` nearest impostors of each row of a group, over blocks in any order; ties by id.

    Single-precision products only leave out what cannot be among them: they are off by less than ``MARGIN`` between unit
    vectors of up to 400 values (longer ones have a margin in proportion). What remains is computed in double precision.
    """

    MARGIN = 5e-5
    #: Rows and columns of a product, which stays in the cache; products computed at a time in double precision; such products after which the nearest are cut.
    ROWS, COLUMNS, EXACT, PENDING = 512, 2048, 4096, 1 << 20

    def __init__(self, keys: list, x: np.ndarray, ref_id: str, k: int, columns: tuple[str, ...]) -> None:
        self.keys, self.ref_id, self.k, self.columns = keys, ref_id, k, columns
        self.u = blocks.unit(x)
        self.u32, self.least = self.u.astype(np.float32), np.full(len(self.u), -np.inf)
        self.margin = self.MARGIN * max(1.0, self.u.shape[1] / 400)
        self.found = [np.zeros(0, dtype=np.int32), np.zeros(0), np.zeros(0, dtype=object), np.zeros(0)]
        self.news, self.pending = [], 0
        self.space: dict = {}

    def see(self, keys: list, x: np.ndarray) -> None:
        keys = np.asarray(keys, dtype=object)
        pick = keys != self.ref_id
        keys, x = keys[pick], x[pick]
        w = blocks.unit(x)
        w32, shade = w.astype(np.float32), x.mean(axis=1, dtype=np.float64)
        for i in range(0, len(self.u), self.ROWS):
            least, u32 = self.least[i : i + self.ROWS], self.u32[i : i + self.ROWS]
            if len(keys) > self.k and not np.isfinite(least).all():  # the k-th of this block is a bound
                bound = np.partition(u32 @ w32.T, -self.k, axis=1)[:, -self.k].astype(np.float64) - self.margin
                np.maximum(least, bound, out=least)
            for j in range(0, len(keys), self.COLUMNS):
                hit = self._hits(u32, w32[j : j + self.COLUMNS], (least - self.margin).astype(np.float32)[:, None])
                if not len(hit):
                    continue
                r, c = np.divmod(hit, min(self.COLUMNS, len(keys) - j))
                r, c = (r + i).astype(np.int32), c + j
                exact = [np.einsum("ij,ij->i", self.u[r[a : a + self.EXACT]], w[c[a : a + self.EXACT]]) for a in range(0, len(r), self.EXACT)]
                self.news.append([r, np.concatenate(exact).round(12), keys[c], shade[c]])
                self.pending += len(r)
                if self.pending > self.PENDING:
                    self._keep()
        if 2 * self.pending > len(self.found[0]):
            self._keep()

    def _hits(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Flat places of the products that reach the bound of their row."""
        shape = (len(a), len(b))
        if shape not in self.space:
            self.space = {shape: (np.empty(shape, np.float32), np.empty(shape, np.bool_))}
        s, h = self.space[shape]
        flat = np.greater_equal(np.matmul(a, b.T, out=s), bound, out=h).ravel()
        if len(flat) % 8:
            return np.flatnonzero(flat)
        at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()  # eight at once, as hits are few
        return at[flat[at]]

    def _keep(self) -> None:
        """Of each row the ``k`` first by similarity, then id."""
        rows, sims, keys, shades = (np.concatenate(c) for c in zip(self.found, *self.news))
        self.news, self.pending = [], 0
        order = np.argsort(-sims)
        order = order[np.argsort(rows[order], kind="stable")]
        first = np.searchsorted(rows[order], np.arange(len(self.u) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        kth = np.full(len(self.u), -np.inf)
        kth[full] = sims[order[first[full] + self.k - 1]]
        np.maximum(self.least, kth, out=self.least)
        order = order[sims[order] >= kth[rows[order]]]
        counts = np.bincount(rows[order], minlength=len(self.u))
        if (counts > self.k).any():  # ties at the k-th
            tied = counts[rows[order]] > self.k
            some = order[tied]
            some = some[np.lexsort((keys[some].astype(str), -sims[some], rows[some]))]
            nth = np.arange(len(some)) - np.searchsorted(rows[some], rows[some])
            order = np.concatenate([order[~tied], some[nth < self.k]])
        self.found = [c[order] for c in (rows, sims, keys, shades)]

    def end(self):
        self._keep()
        rows, sims, keys, shades = self.found
        order = np.lexsort((keys.astype(str), -sims, rows)) if len(rows) else np.zeros(0, dtype=np.int64)
        ends = np.searchsorted(rows[order], np.arange(len(self.u) + 1))
        values = {"sims": (sims, pa.float64()), "impostors": (keys, pa.string()), "shades": (shades, pa.float64())}
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[c][0][order], values[c][1])) for c in self.columns]
        batch = pa.RecordBatch.from_arrays([pa.array(self.keys, pa.string()), *lists], ["utt_id", *self.columns])
        for i in range(0, batch.num_rows, 4096):
            yield batch.slice(i, 4096)


def _top_cohort(corpus: DataFrame, ref_id: str, k: int, block: int, columns: tuple[str, ...] = ("sims", "impostors", "shades")) -> DataFrame:
    """Each vector's ``k`` nearest impostors, ties by id: ``utt_id`` and the lists ``sims, impostors, shades`` (means of their
    vectors' components) that are asked for. A task holds its own vectors and sees all others in turn, so that no list is
    shuffled."""
    size = blocks.block_size(corpus.count(), min(block, blocks.STREAM))
    lists = {"sims": "array<double>", "impostors": "array<string>", "shades": "array<double>"}
    schema = ", ".join(["utt_id string", *[f"{c} {lists[c]}" for c in columns]])
    keyed = corpus.select(F.col("utt_id").cast("string").alias("key"), "v")
    return blocks.streamed(keyed, size, lambda keys, x: _Nearest(keys, x, ref_id, k, columns), schema)


def _mean(x: str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y) / F.size(x)


def _deviation(x: str) -> Column:
    """Of a sample; null of one value."""
    square = F.aggregate(x, F.lit(0.0), lambda acc, y: acc + (y - F.col("mu")) * (y - F.col("mu")))
    return F.when(F.size(x) > 1, F.sqrt(square / (F.size(x) - 1)))


def search(
    corpus: DataFrame, ref_id: str, method: str = "cosine", k: int = COHORT, threshold: float | None = None,
    mode: str = "scalar", block: int = blocks.BLOCK,
) -> DataFrame:
    """Scores of all vectors against ``ref_id``: ``utt_id, score, same_speaker``.

    ``method`` is ``cosine``, ``snorm``, ``asnorm`` (``k`` nearest impostors) or ``adnorm`` (the mean of the ``k``
    nearest impostors is subtracted from both sides: their scalar mean with ``mode='scalar'``, their mean vector with
    ``'vector'``). A cosine decides with >=, a normalised score with >. A cohort smaller than ``k`` is an error.
    """
    v = F.col("v") if dict(corpus.dtypes)["v"] == "array<float>" else vec.as_double(F.col("v"))
    stored = corpus.select(F.col("utt_id").cast("string").alias("utt_id"), v.alias("v"))
    corpus = stored.withColumn("v", vec.as_double(F.col("v")))
    threshold = THRESHOLDS[method] if threshold is None else threshold
    ref = corpus.where(F.col("utt_id") == ref_id).select("v").limit(1)
    scored = corpus.withColumn("rv", ref.scalar()).withColumn("cos", vec.cosine(F.col("rv"), F.col("v")))
    if method == "cosine":
        return scored.select("utt_id", F.col("cos").alias("score"), (F.col("cos") >= threshold).alias("same_speaker"))
    if method == "snorm":
        stats = _cohort_stats(corpus, ref_id)
    else:
        if corpus.where(F.col("utt_id") != ref_id).limit(k).count() < k:
            raise ValueError("the cohort has fewer vectors than k")
        wanted = "sims" if method == "asnorm" else "shades" if mode == "scalar" else "impostors"
        top = _top_cohort(stored, ref_id, k, block, (wanted,))
    if method == "adnorm" and mode == "scalar":
        # with own = the mean of a vector, u = what is left of it: (a - x).(b - y) = u_a.u_b + d (own_a - x)(own_b - y)
        d, own, rown = F.size("v"), vec.scalar_mean(F.col("v")), vec.scalar_mean(F.col("rv"))
        u, ru = vec.minus_scalar(F.col("v"), F.col("own")), vec.minus_scalar(F.col("rv"), F.col("rown"))
        flat = scored.withColumn("own", own).withColumn("rown", rown)
        flat = flat.select("utt_id", "own", "rown", d.alias("d"), vec.dot(ru, u).alias("ab"), vec.dot(u, u).alias("bb"), vec.dot(ru, ru).alias("aa"))
        means = cut_lineage(top.select("utt_id", _mean("shades").alias("m")))
        one = means.where(F.col("utt_id") == ref_id).select("m").limit(1)
        x = flat.join(means, "utt_id").withColumn("y", F.col("own") - F.col("m")).withColumn("x", F.col("rown") - one.scalar())
        length = lambda a, c: F.greatest(F.sqrt(F.col(a) + F.col("d") * F.col(c) * F.col(c)), F.lit(vec.EPS))
        out, score = x, (F.col("ab") + F.col("d") * F.col("x") * F.col("y")) / (length("aa", "x") * length("bb", "y"))
    elif method == "adnorm":
        near = top.select("utt_id", F.explode("impostors").alias("impostor")).join(corpus.select(F.col("utt_id").alias("impostor"), "v"), "impostor")
        means = near.groupBy("utt_id").agg(vec.mean_vector(F.col("v")).alias("m"))
        ref_mean = means.where(F.col("utt_id") == ref_id).select("m").limit(1)
        out = scored.join(means, "utt_id").withColumn("rm", ref_mean.scalar())
        score = vec.cosine(vec.minus(F.col("rv"), F.col("rm")), vec.minus(F.col("v"), F.col("m")))
    else:
        if method == "asnorm":
            stats = top.withColumn("mu", _mean("sims")).withColumn("sigma", _deviation("sims")).select("utt_id", "mu", "sigma")
        stats = cut_lineage(stats)  # read twice
        ref_stats = stats.where(F.col("utt_id") == ref_id).select(F.struct("mu", "sigma").alias("e")).limit(1)
        out = scored.join(stats, "utt_id").withColumn("e", ref_stats.scalar())
        score = ((F.col("cos") - F.col("e.mu")) / F.col("e.sigma") + (F.col("cos") - F.col("mu")) / F.col("sigma")) * 0.5
    out = out.withColumn("score", score)
    return out.select("utt_id", "score", (F.col("score") > threshold).alias("same_speaker"))


def best_reference(candidates: DataFrame, w_quality: float = 0.6, w_similarity: float = 0.4, shown: int = 10) -> DataFrame:
    """Candidates ``utt_id, v, quality`` ranked as enrolment: minmax-scaled quality and cosine with the centroid's
    direction, weighted; the first ``shown`` rows as ``rank, utt_id, quality_norm, similarity_norm, combined``."""
    unit = candidates.select("utt_id", "quality", vec.unit(vec.as_double(F.col("v"))).alias("u"))
    centroid = unit.agg(vec.unit(vec.mean_vector(F.col("u"))).alias("c"))
    sims = unit.withColumn("c", centroid.scalar()).withColumn("sim", vec.dot(F.col("u"), F.col("c")))
    span = sims.agg(F.struct(F.min("sim").alias("s0"), F.max("sim").alias("s1"), F.min("quality").alias("q0"), F.max("quality").alias("q1")).alias("x"))
    out = sims.withColumn("x", span.scalar())
    out = out.withColumn("similarity_norm", (F.col("sim") - F.col("x.s0")) / (F.col("x.s1") - F.col("x.s0") + 1e-10))
    out = out.withColumn("quality_norm", (F.col("quality") - F.col("x.q0")) / (F.col("x.q1") - F.col("x.q0") + 1e-10))
    out = out.withColumn("combined", w_similarity * F.col("similarity_norm") + w_quality * F.col("quality_norm"))
    top = out.orderBy(F.desc(F.round("combined", 12)), "utt_id").limit(shown)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("combined", 12)), "utt_id"))  # over the few rows shown
    return top.select(rank.alias("rank"), "utt_id", "quality_norm", "similarity_norm", "combined")


def adaptive_threshold(scores: DataFrame, kind: str) -> DataFrame:
    """One row ``threshold``: mean minus half the population deviation of the scores of ``kind``, at least ``FLOOR``;
    with ``ENOUGH`` scores or fewer ``FALLBACK``."""
    own = F.when(F.col("kind") == kind, F.col("score"))
    adaptive = F.greatest(F.lit(FLOOR), F.avg(own) - FACTOR * F.stddev_pop(own))
    return scores.agg(F.when(F.count(own) > ENOUGH, adaptive).otherwise(F.lit(FALLBACK)).alias("threshold"))


def five_numbers(scores: DataFrame) -> DataFrame:
    """What a box plot of the scores of each kind needs: ``kind, n, low, q1, median, q3, high``."""
    q = F.percentile("score", [0.25, 0.5, 0.75])
    x = scores.groupBy("kind").agg(F.count("score").alias("n"), F.min("score").alias("low"), q.alias("q"), F.max("score").alias("high"))
    return x.select("kind", "n", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def decide(scores: DataFrame, threshold: DataFrame) -> DataFrame:
    """Scores with ``same_speaker`` by the one row ``threshold``."""
    one = threshold.select("threshold").limit(1)
    return scores.withColumn("threshold", one.scalar()).withColumn("same_speaker", F.col("score") >= F.col("threshold"))


def decision_stats(decided: DataFrame) -> DataFrame:
    """Counts by kind, by discussion and over all (``kind`` or ``discussion`` null): ``n_same, n_diff, n, pct_same``."""
    same = F.count(F.when(F.col("same_speaker"), 1))
    by = decided.groupingSets([["kind"], ["discussion"], []], "kind", "discussion")
    return by.agg(
        same.alias("n_same"), (F.count("*") - same).alias("n_diff"), F.count("*").alias("n"),
        F.when(F.count("*") > 0, 100.0 * same / F.count("*")).otherwise(0.0).alias("pct_same"),
    )
