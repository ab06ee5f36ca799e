"""Long character spans that occur verbatim in more than one document.

A difference cover of period ``v`` is a set of residues such that for any two positions some shift below ``v`` brings
both to a residue of the set. So if every document hashes windows only at positions whose residue is in the cover, any
two equal spans of at least ``v - 1 + window`` characters share a window that both hashed: an anchor. Anchors travel in
packed arrays, one row a bucket and batch, and of a batch each hash at most twice, so a hash that a third of all
documents have stays small. Where a hash occurs in two documents, the spans that could run over it are grown: they are
cut where their minimizer (the least hash of a short window inside a span) changes, and the pieces of text meet by
minimizer, where all spans of the minimal length are compared by a hash of 128 bits. A span and its twin have the same
text, hence the same minimizer, so they meet. A minimizer with too much text for one task is compared span by span
instead, reduced map side to the smallest and greatest document of each span.

Whole copies are folded first: equal texts are one representative, and copies are shared from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parolis.runtime import cut_lineage

#: Code points hashed at a time (longer texts go in overlapping pieces) and anchors packed at a time.
CHUNK, PACKED = 1 << 19, 1 << 21
#: Rows of ids or hashes that are still broadcast; more of them meet the other side by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of anchors and characters of text that one group may hold; characters under one minimizer beyond which spans
#: are compared one by one.
GROUP_BYTES, GROUP_CHARS, HOT_CHARS = 64 << 20, 2 << 20, 2 << 20
#: Length of the windows that minimizers are chosen among.
MINIMIZER = 31

_U64 = np.uint64
#: Bits of an anchor hash. Equal hashes of unlike windows only make more spans to compare.
_ANCHOR_BITS = (1 << 48) - 1


def difference_cover(q: int) -> tuple[int, list[int]]:
    """Singer's perfect difference set for a prime ``q``: period ``q^2 + q + 1`` and its ``q + 1`` residues, the zeros of
    a recurrence of order three over the integers modulo ``q``."""
    period = q * q + q + 1
    for c0 in range(1, q):
        for c1 in range(q):
            for c2 in range(q):
                state, zeros = (0, 0, 1), []
                for n in range(period):
                    if not state[0]:
                        zeros.append(n)
                    state = (state[1], state[2], (c0 * state[0] + c1 * state[1] + c2 * state[2]) % q)
                if len(zeros) == q + 1 and len({(a - b) % period for a in zeros for b in zeros}) == period:
                    return period, zeros
    raise ValueError("no difference set of this order")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class RollingHash:
    """Window hashes of an array of code points from prefix sums modulo 2^64; the base is odd, hence invertible."""

    def __init__(self, base: int, salt: int):
        self.base, self.salt = base | 1, salt
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers = self._inverses = np.ones(1, dtype=_U64)
        self._values: np.ndarray | None = None

    def _grown(self, n: int) -> None:
        if len(self._powers) < n:
            size = max(n, 2 * len(self._powers))
            with np.errstate(over="ignore"):
                for name, b in (("_powers", self.base), ("_inverses", self.inverse)):
                    x = np.full(size, b, dtype=_U64)
                    x[0] = 1
                    setattr(self, name, np.cumprod(x, dtype=_U64))

    def _of(self, codes: np.ndarray) -> np.ndarray:
        """A value for each code point; those of the basic plane come from a table."""
        if self._values is None:
            self._values = _mixed(np.arange(1 << 16, dtype=_U64) + _U64(self.salt))
        if not len(codes) or codes.max() < 1 << 16:
            return self._values[codes]
        return _mixed(codes.astype(_U64) + _U64(self.salt))

    def windows(self, codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        self._grown(len(codes) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(codes) + 1, dtype=_U64)
            np.cumsum(self._of(codes) * self._powers[: len(codes)], out=sums[1:])
            return _mixed((sums[at + width] - sums[at]) * self._inverses[at]).view(np.int64)


_ANCHOR = RollingHash(0x9E3779B97F4A7C15, 0x1234567)
_SPAN_A = RollingHash(0xD1342543DE82EF95, 0x7654321)
_SPAN_B = RollingHash(0xA0761D6478BD642F, 0x2468ACE)
_SHORT = RollingHash(0xE7037ED1A0B428DB, 0x1357913)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class _Block:
    """Pieces of documents one after another: text, code points, and for each piece its document, its place in the block
    and its place in the document."""

    def __init__(self, parts: list[tuple[int, int, str]]):
        self.text = "".join(t for _, _, t in parts)
        self.codes = code_points(self.text)
        self.doc = np.array([i for i, _, _ in parts], dtype=np.int64)
        self.base = np.array([a for _, a, _ in parts], dtype=np.int64)
        self.size = np.array([len(t) for _, _, t in parts], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size


def _blocks(ids: list, texts: list, period: int, length: int) -> Iterator[_Block]:
    """Whole documents, those longer than a chunk in parts that begin at a multiple of the period and overlap by less
    than a span, so that every span lies in a part."""
    step, held, size = CHUNK // period * period, [], 0
    for i, t in zip(ids, texts):
        for a in range(0, max(1, len(t) - length + 1), step):
            part = t[a : a + step + length - 1]
            held.append((i, a, part))
            size += len(part)
            if size >= CHUNK:
                yield _Block(held)
                held, size = [], 0
    if held:
        yield _Block(held)


class _Cover:
    """Places of a block at which anchors are hashed."""

    def __init__(self, period: int, cover: list[int], width: int):
        self.period, self.width = period, width
        self.residues = np.array(sorted(cover), dtype=np.int64)

    def anchors(self, block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, place in the block, piece)."""
        n = np.maximum(0, block.size - self.width + 1)
        k = len(self.residues)
        count = n // self.period * k + np.searchsorted(self.residues, n % self.period)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        piece = np.repeat(np.arange(len(n)), count)
        at = nth // k * self.period + self.residues[nth % k] + block.start[piece]
        return _ANCHOR.windows(block.codes, at, self.width) & _ANCHOR_BITS, at, piece


def _few(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which anchors of a batch to keep, in their order: of each hash the first, and the last if its document is another."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    last = np.concatenate((first[1:], [True]))
    begin = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return np.sort(order[first | (last & (doc[order] != doc[begin]))])


def _packed(cover: _Cover, length: int, buckets: int):
    """Documents -> rows (bucket, hashes of 6 bytes, documents of 8 bytes), the arrays packed as bytes."""

    def pack(hs: list, ds: list) -> pa.RecordBatch:
        h, d = np.concatenate(hs), np.concatenate(ds)
        keep = _few(h, d)
        h, d = h[keep], d[keep]
        bucket = (h % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        h, d, bucket = h[order], d[order], bucket[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.concatenate((cut[1:], [len(h)]))
        six = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6])
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cut]), pa.array([six[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary()), pa.array([d[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary())],
            ["bucket", "hashes", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ds, n = [], [], 0
        for b in batches:
            for block in _blocks(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), cover.period, length):
                h, _, piece = cover.anchors(block)
                if not len(h):
                    continue
                hs.append(h)
                ds.append(block.doc[piece])
                n += len(h)
                if n >= PACKED:
                    yield pack(hs, ds)
                    hs, ds, n = [], [], 0
        if hs:
            yield pack(hs, ds)

    return run


def _twice(t: pa.Table) -> pa.Table:
    """Hashes of one bucket that more than one document has."""
    raw = np.frombuffer(b"".join(t.column("hashes").to_pylist()), dtype=np.uint8).reshape(-1, 6)
    h = np.zeros((len(raw), 8), dtype=np.uint8)
    h[:, :6] = raw
    h = h.view(np.int64).ravel()
    d = np.frombuffer(b"".join(t.column("docs").to_pylist()), dtype=np.int64)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    if len(cut):
        cut = cut[np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut)]
    return pa.table({"h": pa.array(h[cut])})


def _listed(cover: _Cover, length: int):
    """Documents -> a row (hash, doc_id, position) for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in _blocks(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), cover.period, length):
                h, at, piece = cover.anchors(block)
                where = at - block.start[piece] + block.base[piece]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(block.doc[piece]), pa.array(where.astype(np.int32))], ["h", "doc_id", "pos"])

    return run


class _Sorted:
    """Membership in a sorted array, after a look into a table of bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(10, min(26, int(len(keys)).bit_length() + 4))
        self.mask = (1 << bits) - 1
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[keys & self.mask] = True

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = self.table[h & self.mask]
        at = np.flatnonzero(out)
        if len(at):
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            out[at] = self.keys[k] == h[at]
        return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _mers(block: _Block, at: np.ndarray, piece: np.ndarray, length: int, reach: int) -> tuple | None:
    """Pieces of text under one minimizer: (minimizer, doc_id, position, text) of all spans that run over the anchors."""
    lo = np.maximum(at - reach, block.start[piece])
    hi = np.minimum(at, block.start[piece] + block.size[piece] - length)
    ok = hi >= lo
    mark = np.zeros(len(block.codes) + 1, dtype=np.int32)
    np.add.at(mark, lo[ok], 1)
    np.add.at(mark, hi[ok] + 1, -1)
    live = np.flatnonzero(np.cumsum(mark) > 0)  # documents are apart: no span begins in the last of one
    if not len(live):
        return None
    cut = np.flatnonzero(np.concatenate(([True], np.diff(live) > 1)))
    first, n = live[cut], np.diff(np.concatenate((cut, [len(live)])))
    # the zones with the rest of their last span, one after another
    size = n + length - 1
    begin = np.cumsum(size) - size
    zone = block.codes[np.arange(size.sum()) - np.repeat(begin - first, size)]
    short = _SHORT.windows(zone, np.arange(len(zone) - MINIMIZER + 1), MINIMIZER)
    least = _sliding_min(short, length - MINIMIZER + 1)
    least = least[np.arange(len(live)) - np.repeat(np.cumsum(n) - n - begin, n)]
    new = np.zeros(len(live), dtype=bool)
    new[cut] = True
    new[1:] |= least[1:] != least[:-1]
    a = np.flatnonzero(new)
    z = np.concatenate((a[1:], [len(live)])) - 1
    start, end = live[a], live[z] + length
    owner = np.searchsorted(block.start, start, side="right") - 1
    return least[a], block.doc[owner], start - block.start[owner] + block.base[owner], [block.text[x:y] for x, y in zip(start.tolist(), end.tolist())]


def _grown(cover: _Cover, length: int, shared=None):
    """Documents -> rows (minimizer, doc_id, position, text). The anchors that occur elsewhere are found by the
    broadcast hashes or stand in the column ``anchors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else _Sorted(shared.value)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            given = None if known else {i: np.sort(x.values.to_numpy()) for i, x in zip(ids, b.column("anchors"))}
            for block in _blocks(ids, texts, cover.period, length):
                if known:
                    h, at, piece = cover.anchors(block)
                    hit = known.holds(h)
                    at, piece = at[hit], piece[hit]
                else:
                    found = []
                    for i, a, n in zip(block.doc.tolist(), block.base.tolist(), block.size.tolist()):
                        x = given[i]
                        found.append(x[np.searchsorted(x, a) : np.searchsorted(x, a + n - cover.width + 1)].astype(np.int64) - a)
                    piece = np.repeat(np.arange(len(found)), [len(x) for x in found])
                    at = np.concatenate(found) + block.start[piece]
                out = _mers(block, at, piece, length, cover.period - 1) if len(at) else None
                if out:
                    least, doc, pos, text = out
                    yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(doc), pa.array(pos), pa.array(text, pa.string())], ["mini", "doc_id", "pos", "text"])

    return run


def _all_spans(t: pa.Table | pa.RecordBatch, length: int):
    """Hashes, row and position of every span of the texts of a table."""
    texts = t.column("text").to_pylist()
    codes = code_points("".join(texts))
    size = np.array([len(x) for x in texts], dtype=np.int64)
    n = size - length + 1
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = nth + np.repeat(np.cumsum(size) - size, n)
    return _SPAN_A.windows(codes, at, length), _SPAN_B.windows(codes, at, length), row, nth


def _matched(length: int):
    """Texts of one group -> stretches (doc_id, char_start, char_end) of spans that another document has."""

    def run(t: pa.Table) -> pa.Table:
        ha, hb, row, nth = _all_spans(t, length)
        docs, pos = t.column("doc_id").to_numpy(), t.column("pos").to_numpy()
        doc = docs[row]
        order = np.lexsort((hb, ha))
        a, b = ha[order], hb[order]
        cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        d = doc[order]
        shared = np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut)
        hit = np.zeros(len(ha), dtype=bool)
        hit[order] = np.repeat(shared, np.diff(np.concatenate((cut, [len(d)]))))
        live = np.flatnonzero(hit)
        if not len(live):
            return pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "char_start", "char_end")})
        new = np.concatenate(([True], (np.diff(live) > 1) | (np.diff(row[live]) > 0)))
        s = live[new]
        e = live[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(live) - 1]))]
        first = pos[row[s]] + nth[s]
        return pa.table({"doc_id": doc[s], "char_start": first, "char_end": first + (e - s) + length})

    return run


def _spans(length: int):
    """Texts -> a row (two hashes, doc_id, position) for each span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ha, hb, row, nth = _all_spans(part, length)
                docs, pos = part.column("doc_id").to_numpy(), part.column("pos").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ha), pa.array(hb), pa.array(docs[row]), pa.array(pos[row] + nth)], ["ha", "hb", "doc_id", "pos"])

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, starts and ends of its stretches) -> merged stretches; overlapping and touching ones are one."""
    for b in batches:
        ids, starts, ends = [], [], []
        for i, at in zip(b.column("doc_id").to_pylist(), b.column("at")):
            a, z = (at.values.field(k).to_numpy() for k in (0, 1))
            order = np.argsort(a, kind="stable")
            a, reach = a[order], np.maximum.accumulate(z[order])
            cut = np.flatnonzero(a[1:] > reach[:-1])
            starts.append(a[np.concatenate(([0], cut + 1))])
            ends.append(reach[np.concatenate((cut, [len(a) - 1]))])
            ids.append(np.full(len(cut) + 1, i, dtype=np.int64))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, starts, ends)], ["doc_id", "char_start", "char_end"])


def _hinted(df: DataFrame, n: int, most: int) -> DataFrame:
    """With a broadcast hint only where the number of rows was counted to be small."""
    return F.broadcast(df) if n <= most else df


def shared_spans(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 240, order: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS, hot_chars: int = HOT_CHARS,
) -> DataFrame:
    """Rows ``doc_id, char_start, char_end``: the stretches of each document covered by spans of ``length`` or more code
    points that occur verbatim in another document; overlapping and touching spans are one stretch.

    Null texts, texts shorter than ``length`` and rows with a null id have none. A repeat inside one document alone does
    not count; rows that repeat both id and text are one document. Ids must name one text each. Other columns are not
    read. Texts of any length are hashed whole. An empty table gives an empty result. ``order`` is the prime of the
    difference cover (by default the greatest that leaves windows of two fifths of a span); ``broadcast_rows`` and
    ``hot_chars`` change the way a result is reached, not the result.
    """
    spark = df.sparkSession
    order = order or max((q for q in (2, 3, 5, 7, 11, 13) if length - q * q - q >= 0.4 * length), default=2)
    period, residues = difference_cover(order)
    cover = _Cover(period, residues, length - period + 1)
    if cover.width < 16 or length < MINIMIZER:
        raise ValueError("the spans are too short for this difference cover")
    docs = df.select(df[doc_id].cast("bigint").alias("doc_id"), df[text].cast("string").alias("text"))
    docs = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # whole copies: one representative a text, known by its digest and length
    keyed = cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("d1"), F.md5("text").alias("d2"), F.length("text").alias("n")))
    copies = keyed.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("hi")).where("rep < hi")
    copied = cut_lineage(keyed.join(copies, ["d1", "d2", "n"]).select("doc_id", "rep", "n").distinct())
    whole = copied.select("doc_id", F.lit(0).cast("bigint").alias("char_start"), F.col("n").cast("bigint").alias("char_end"))
    n_copied, chars = copied.count(), keyed.agg(F.sum("n")).first()[0] or 0
    reps = docs.join(_hinted(copied.where("doc_id > rep").select("doc_id"), n_copied, broadcast_rows), "doc_id", "left_anti")

    buckets = max(2 * partitions, chars * len(residues) // period * 14 // GROUP_BYTES)
    packed = reps.mapInArrow(_packed(cover, length, buckets), "bucket int, hashes binary, docs binary")
    twice = cut_lineage(packed.groupBy("bucket").applyInArrow(_twice, "h bigint"))
    if twice.count() <= broadcast_rows:
        keys = np.sort(twice.toArrow().column("h").to_numpy()) if broadcast_rows else np.empty(0, np.int64)
        grown = reps.mapInArrow(_grown(cover, length, spark.sparkContext.broadcast(keys)), _MERS) if len(keys) else None
    else:
        hits = reps.mapInArrow(_listed(cover, length), "h bigint, doc_id bigint, pos int").join(twice, "h", "left_semi")
        hits = hits.groupBy("doc_id").agg(F.collect_set("pos").alias("anchors"))  # no more than a document has characters
        grown = reps.join(hits, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_grown(cover, length), _MERS)
    if grown is None:
        return whole

    grown = cut_lineage(grown)
    sizes = grown.groupBy("mini").agg(F.sum(F.length("text")).alias("c"))
    hot = cut_lineage(sizes.where(F.col("c") > hot_chars).select("mini"))
    n_hot, chars = hot.count(), grown.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(2 * partitions, chars // GROUP_CHARS)
    cool = grown.join(_hinted(hot, n_hot, broadcast_rows), "mini", "left_anti") if n_hot else grown
    cool = cool.withColumn("g", F.pmod("mini", F.lit(groups)))
    found = cool.groupBy("g").applyInArrow(_matched(length), "doc_id bigint, char_start bigint, char_end bigint")
    if n_hot:
        spans = grown.join(_hinted(hot, n_hot, broadcast_rows), "mini", "left_semi").mapInArrow(_spans(length), "ha bigint, hb bigint, doc_id bigint, pos bigint")
        two = spans.groupBy("ha", "hb").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("ha", "hb")
        each = spans.join(two, ["ha", "hb"], "left_semi").select("doc_id", F.col("pos").alias("char_start"), (F.col("pos") + length).alias("char_end"))
        found = found.unionByName(each)
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("char_start", "char_end")).alias("at"))
    parts = found.mapInArrow(_stretches, "doc_id bigint, char_start bigint, char_end bigint")
    return parts.join(_hinted(copied.select("doc_id"), n_copied, broadcast_rows), "doc_id", "left_anti").unionByName(whole)


_MERS = "mini bigint, doc_id bigint, pos bigint, text string"


def shared_share(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 240) -> DataFrame:
    """Per document with a text: ``doc_id, n_chars, shared_chars, share``; ``share`` is 0 for an empty text."""
    docs = df.select(df[doc_id].cast("bigint").alias("doc_id"), F.length(df[text]).cast("bigint").alias("n_chars"))
    docs = docs.where("doc_id IS NOT NULL AND n_chars IS NOT NULL").distinct()
    covered = shared_spans(df, doc_id, text, length).groupBy("doc_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("c"))
    out = docs.join(covered, "doc_id", "left").withColumn("shared_chars", F.coalesce("c", F.lit(0)))
    share = F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0)
    return out.select("doc_id", "n_chars", "shared_chars", F.round(share, 6).alias("share"))
