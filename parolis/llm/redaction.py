"""Finding and replacing personal values with the trained trees."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parolis.llm.boosting import BoostedTrees, platt
from parolis.llm.personal import COMMON, KINDS, N_FEATURES, candidates, prepare, resolve
from parolis.llm.synthetic import SENTENCES, labelled


@dataclass
class Redactor:
    """Trees, their calibration and the threshold of each kind."""

    trees: BoostedTrees
    slope: float
    offset: float
    thresholds: np.ndarray

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Per text the spans (start, end, kind) of its values, left to right, as positions in its NFC form."""
        per_text, rows = [], []
        for t in texts:
            c = candidates(*prepare(t)) if t else []
            per_text.append(c)
            rows.extend(x.features for x in c)
        if not rows:
            return [[] for _ in texts]
        margin = self.trees.margin(np.asarray(rows, dtype=np.float64))
        prob = 1 / (1 + np.exp(-(self.slope * margin + self.offset)))
        out, at = [], 0
        for c in per_text:
            out.append(resolve(c, prob[at : at + len(c)], self.thresholds) if c else [])
            at += len(c)
        return out


def _rows(sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    x, y, kind, where = [], [], [], []
    for i, (text, spans) in enumerate(sentences):
        p, found = prepare(text)
        if len(p.text) != len(text):
            continue
        truth = {(a, z, KINDS.index(k)) for a, z, k in spans}
        for c in candidates(p, found):
            near = any(k == c.kind and 10 * (min(z, c.end) - max(a, c.start)) >= 7 * (max(z, c.end) - min(a, c.start)) for a, z, k in truth)
            x.append(c.features)
            y.append(float(near))
            kind.append(c.kind)
            where.append((i, c.start, c.end))
    return np.asarray(x, dtype=np.float64).reshape(-1, N_FEATURES), np.asarray(y), np.asarray(kind), where


@functools.lru_cache(maxsize=2)
def trained(sentences: int = SENTENCES, seed: int = 11) -> Redactor:
    """The redactor, fitted on two thirds of ``sentences`` labelled sentences and calibrated on the rest."""
    data = labelled(sentences, seed)
    cut = sentences * 2 // 3
    x, y, _, _ = _rows(data[:cut])
    trees = BoostedTrees().fit(x, y)
    xc, yc, kc, _ = _rows(data[cut:])
    margin = trees.margin(xc)
    slope, offset = platt(margin, yc)
    prob = 1 / (1 + np.exp(-(slope * margin + offset)))
    thresholds = np.full(len(KINDS), 0.5)
    for k in range(len(KINDS)):
        p, t = prob[kc == k], yc[kc == k]
        grid = np.linspace(0.2, 0.8, 25)
        hits = np.array([((p >= g) & (t > 0)).sum() for g in grid], dtype=float)
        # a missed value costs more than a word too many: recall counts twice
        f2 = 5 * hits / np.maximum(1, np.array([(p >= g).sum() for g in grid]) + 4 * (t > 0).sum())
        best = np.flatnonzero(f2 >= f2.max() - 1e-9)
        thresholds[k] = grid[best[len(best) // 2]]
    return Redactor(trees, slope, offset, thresholds)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                found = r.find(part.column("text").to_pylist())
                keep = [i for i, f in enumerate(found) if f]
                if keep:
                    kinds = pa.array([[k for _, _, k in found[i]] for i in keep], pa.list_(pa.string()))
                    idx = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([part.column("origin").take(idx), part.column("row_id").take(idx), kinds], ["origin", "row_id", "kinds"])

    return run


def personal_values(texts: DataFrame, model: Redactor | None = None) -> DataFrame:
    """Rows ``origin, row_id, kind, nth`` of the values in ``texts`` (``origin, row_id, text``).

    ``nth`` counts a text's values of one kind from 1, left to right. A row given again with the same origin and id
    counts once. Null or blank texts have none; rows with a null id are ignored. Texts are read whole, whatever their
    length. An empty table gives an empty result.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model or trained())
    rows = texts.select("origin", F.col("row_id").cast("bigint").alias("row_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("row_id IS NOT NULL AND text IS NOT NULL")
    found = rows.mapInArrow(_find(shared), "origin string, row_id bigint, kinds array<string>")
    once = found.groupBy("origin", "row_id").agg(F.max("kinds").alias("kinds"))
    each = once.select("origin", "row_id", F.posexplode("kinds").alias("at", "kind"), "kinds")
    nth = F.size(F.filter(F.slice("kinds", 1, F.col("at") + 1), lambda k: k == F.col("kind")))
    return each.select("origin", "row_id", "kind", nth.cast("int").alias("nth"))


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The NFC text with each span replaced by its placeholder, for example ``[PHONE]``."""
    out, at = [], 0
    for a, z, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join([*out, text[at:]])


_EDGES, _RUNS = re.compile(r"^\W+|\W+$"), re.compile(r"\w+")


def _key(word: str) -> str:
    return _EDGES.sub("", word).casefold()


def _keys(text: str) -> set[str]:
    """Words of a span as they may be spoken: between blanks without outer punctuation, and runs of letters and digits."""
    return ({_key(w) for w in text.split()} | {w.casefold() for w in _RUNS.findall(text)}) - {""}


def redact_words(text: str, spans: list[tuple[int, int, str]], words: list[str | None]) -> list[str | None]:
    """The spoken words of ``text``: the first word in a span becomes its placeholder, its further words go empty.

    Words are looked up in the text in order, to its end (labels, stamps and annotations stand between); a null stays as
    it is. A word that is not found goes by the first span that has a word equal to it, and stays if there is none. Where
    words of a span were met elsewhere, as digits in a stamp, the words of the list equal to them go as well, common words
    and single letters excepted.
    """
    at, nth, gone, lost, owner, said = 0, 0, set(), set(), [-1] * len(words), [0] * len(spans)
    edge = lambda i: i <= 0 or i >= len(text) or not (text[i - 1].isalnum() and text[i].isalnum())
    letters = lambda a, z: sum(c.isalnum() for c in text[a:z])
    for i, w in enumerate(words):
        here = text.find(w, at) if w and w not in gone else -1
        while here >= 0 and not (edge(here) and edge(here + len(w))):  # inside another word
            here = text.find(w, here + 1)
        if here < 0:
            gone.add(w)  # nor is it further on
            lost.add(i)
            continue
        at = here + len(w)
        while nth < len(spans) and spans[nth][1] <= here:
            nth += 1
        if nth < len(spans) and spans[nth][0] < at:
            owner[i] = nth
        for j in range(nth, len(spans)):
            if spans[j][0] >= at:
                break
            said[j] += letters(max(here, spans[j][0]), min(at, spans[j][1]))
    unsaid = [j for j, (a, z, _) in enumerate(spans) if said[j] < letters(a, z)]
    if lost or unsaid:
        every, missed = {}, {}
        for j, (a, z, _) in enumerate(spans):
            for w in _keys(text[a:z]):
                every.setdefault(w, j)
        for j in unsaid:
            for w in _keys(text[spans[j][0] : spans[j][1]]):
                if w not in COMMON and (len(w) > 1 or w.isdigit()):
                    missed.setdefault(w, j)
        for i, w in enumerate(words):
            if w and owner[i] < 0:
                key = _key(w)
                owner[i] = missed.get(key, every.get(key, -1) if i in lost else -1)
    out, named = [], -1
    for w, j in zip(words, owner):
        if j < 0:
            out.append(w)
        else:
            out.append("" if j == named else f"[{spans[j][2].upper()}]")
            named = j
    return out


def _redact(shared):
    import unicodedata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                texts, words = part.column("text").to_pylist(), part.column("words").to_pylist()
                nfc = [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
                found = r.find(texts)
                clean = [None if t is None else redact_text(t, s) for t, s in zip(nfc, found)]
                said = [
                    w if w is None or not t or not s else redact_words(t, s, [None if x is None else unicodedata.normalize("NFC", x) for x in w])
                    for t, s, w in zip(nfc, found, words)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("origin"), part.column("row_id"), pa.array(clean, pa.string()), pa.array(said, pa.list_(pa.string())), pa.array([len(f) for f in found], pa.int32())],
                    ["origin", "row_id", "text", "words", "n_values"],
                )

    return run


def redacted(texts: DataFrame, model: Redactor | None = None) -> DataFrame:
    """``origin, row_id, text, words, n_values``: texts and words (``array<string>``) with placeholders in place of
    personal values. Every row of ``texts`` gives one row; null texts and null words stay null."""
    shared = texts.sparkSession.sparkContext.broadcast(model or trained())
    rows = texts.select("origin", F.col("row_id").cast("bigint").alias("row_id"), F.col("text").cast("string").alias("text"), "words")
    return rows.mapInArrow(_redact(shared), "origin string, row_id bigint, text string, words array<string>, n_values int")
