"""Which training documents contain passages of held-out test items.

The items are an inverted index: for each word the items that hold it, in order, with their BM25 impacts, cut into blocks
with the greatest impact of each. Every document is cut into passages and each passage queries the index by block-max
WAND: the lists of its words are walked in order of item, an item is the pivot when the greatest impacts of the lists
that have reached it add up to the threshold, and it is scored only if its blocks' maxima do as well; else the lists skip
to where a block ends. Many passages are walked in lockstep. The threshold of an item is the least BM25 score that any
``n`` consecutive words of it can have, so no leak scores below it; impacts are divided by it, which makes the common
threshold 1. Retrieved pairs are then verified word for word.

The documents are read once and never shuffled; the index goes to the tasks, in shards of a bounded number of items that
are held one at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parolis.llm.words import words_of

#: Items of one index shard (the proven bound of what a task holds), postings of a block, words of a query passage.
SHARD_ITEMS = 16_384
BLOCK = 16
PASSAGE_WORDS = 64
#: Shards whose index stays in a task's memory between batches.
KEPT_SHARDS = 4

_SLACK = 1e-3
_K1, _B = 1.2, 0.75
_LOCKSTEP = 2048


class Bm25Index:
    """Inverted index of one shard of test items with block maxima, as flat arrays in order of word and item."""

    def __init__(self, items: list[tuple], n: int):
        docs = sorted(((i, words_of(t), words_of(x[0] if x else None)) for i, t, *x in items), key=lambda x: (" ".join(x[1]), x[0]))
        docs = [d for d in docs if len(d[1]) >= n]
        self.n = n
        self.item_ids = np.array([i for i, _, _ in docs], dtype=np.int64)
        self.answers = [frozenset(a) for _, _, a in docs]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], dtype=np.int32) for _, w, _ in docs]
        size, v = len(docs), len(self.vocabulary)
        df = np.zeros(v)
        for c in self.words:
            df[np.unique(c)] += 1
        idf = np.log1p((size - df + 0.5) / (df + 0.5))
        mean = sum(map(len, self.words)) / max(1, size)
        word, item, impact = [], [], []
        for k, c in enumerate(self.words):
            norm = _K1 * (1 - _B + _B * len(c) / mean)
            score = {w: float(idf[w] * f * (_K1 + 1) / (f + norm)) for w, f in Counter(c.tolist()).items()}
            codes = c.tolist()
            least = min(sum(score[w] for w in set(codes[j : j + n])) for j in range(len(codes) - n + 1))
            word += score.keys()
            item += [k] * len(score)
            impact += [s / least for s in score.values()]
        word, item = np.array(word, dtype=np.int64), np.array(item, dtype=np.int64)
        order = np.lexsort((item, word))
        word, self.item, self.impact = word[order], item[order], np.array(impact, dtype=np.float64)[order]
        self.size = max(1, size)
        self.key = word * self.size + self.item  # sorted: one search finds an item in any list
        self.first = np.searchsorted(word, np.arange(v + 1))
        self.ceiling = np.maximum.reduceat(self.impact, self.first[:-1]) if v else np.empty(0)
        # blocks of a list; each posting knows the greatest impact and the last item of its block
        block = (np.arange(len(word)) - self.first[word]) // BLOCK if v else np.empty(0, np.int64)
        starts = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])))) if v else np.empty(0, np.int64)
        length = np.diff(np.concatenate((starts, [len(word)])))
        self.block_max = np.repeat(np.maximum.reduceat(self.impact, starts), length) if v else np.empty(0)
        self.block_end = np.repeat(self.item[starts + length - 1], length) if v else np.empty(0, np.int64)
        #: Postings of the lists that were queried, and postings whose impact was read.
        self.queried = self.read = 0

    def retrieve(self, passages: list[list[int]]) -> list[tuple[int, int]]:
        """(passage, item position) of all pairs whose BM25 score reaches the threshold."""
        terms = [np.unique(p) for p in passages]
        by_size = sorted(range(len(terms)), key=lambda i: len(terms[i]))
        out: list[tuple[int, int]] = []
        for at in range(0, len(by_size), _LOCKSTEP):
            part = by_size[at : at + _LOCKSTEP]
            out.extend(self._walk(np.array(part), [terms[i] for i in part]))
        return out

    def _walk(self, who: np.ndarray, terms: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Block-max WAND of some passages at a time; a row a passage, a column a list."""
        width, far, least = max(map(len, terms)), self.size, 1 - _SLACK
        term = np.zeros((len(terms), width), dtype=np.int64)
        used = np.zeros(term.shape, dtype=bool)
        for r, t in enumerate(terms):
            term[r, : len(t)], used[r, : len(t)] = t, True
        at, end = self.first[term], np.where(used, self.first[term + 1], 0)
        self.queried += int((end - at)[used].sum())
        ceiling = np.where(used, self.ceiling[term], 0.0)
        top = len(self.item) - 1
        while len(who):
            here = np.where(at < end, self.item[np.minimum(at, top)], far)
            order = np.argsort(here, axis=1, kind="stable")
            reach = np.take_along_axis(np.where(here < far, ceiling, 0.0), order, 1).cumsum(axis=1)
            full = reach >= least
            go = full[:, -1]
            if not go.all():
                who, term, at, end, ceiling, here, order, full = (x[go] for x in (who, term, at, end, ceiling, here, order, full))
                if not len(who):
                    return
            rows = np.arange(len(who))
            pivot = here[rows, order[rows, full.argmax(axis=1)]][:, None]
            involved = here <= pivot
            spot = np.where(involved, np.searchsorted(self.key, term * self.size + pivot), at)  # where the list reaches the pivot
            inside = involved & (spot < end)
            safe = np.minimum(spot, top)
            bound = np.where(inside, self.block_max[safe], 0.0).sum(axis=1)
            live = bound >= least
            match = inside & (self.item[safe] == pivot) & live[:, None]
            self.read += int(match.sum())
            score = np.where(match, self.impact[safe], 0.0).sum(axis=1)
            hit = live & (score >= least)
            yield from zip(who[hit].tolist(), pivot[hit, 0].tolist())
            # past the pivot, or to where the first of its blocks ends or another list begins
            skip = np.minimum(np.where(inside, self.block_end[safe] + 1, far).min(axis=1), np.where(involved, far, here).min(axis=1))
            target = np.where(live, pivot[:, 0] + 1, np.maximum(skip, pivot[:, 0] + 1))[:, None]
            at = np.where(involved, np.minimum(np.searchsorted(self.key, term * self.size + np.minimum(target, far - 1)) + (target >= far), end), at)
            at = np.where(involved & (target >= far), end, at)

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(text position, item id) of all leaks."""
        return [(d, int(self.item_ids[i])) for d, i in self.find([words_of(t) for t in texts])]

    def find(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(text position, item position) of all leaks in texts given as words."""
        n, known = self.n, self.vocabulary.get
        passages: list[list[int]] = []
        owner: list[int] = []
        for d, words in enumerate(texts):
            run: list[int] = []
            for w in [known(x, -1) for x in words] + [-1]:
                if w >= 0:
                    run.append(w)
                    continue
                if len(run) >= n:  # no leak holds a word that no item has
                    for j in range(0, len(run) - n + 1, PASSAGE_WORDS - n + 1):
                        passages.append(run[j : j + PASSAGE_WORDS])
                        owner.append(d)
                run = []
        if not passages or not len(self.item_ids):
            return []
        grams_of = lambda w: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
        found, grams, last = set(), set(), -1
        for p, i in sorted(self.retrieve(passages)):
            if (owner[p], i) in found:
                continue
            if p != last:
                grams, last = grams_of(passages[p]), p
            if not grams.isdisjoint(grams_of(self.words[i].tolist())):
                found.add((owner[p], i))
        return list(found)


def _search(shards: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                ids = part.column(0).to_pylist()
                words = [words_of(t) for t in part.column(1).to_pylist()]
                docs, items, shares = [], [], []
                for shared in shards:
                    index = shared.value
                    for d, i in index.find(words):
                        docs.append(ids[d])
                        items.append(int(index.item_ids[i]))
                        answer = index.answers[i]
                        shares.append(len(answer.intersection(words[d])) / len(answer) if answer else None)
                    if len(shards) > KEPT_SHARDS:
                        del index
                        shared.__dict__.pop("_value", None)  # read again for the next batch
                if docs:
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(docs, pa.int64()), "item_id": pa.array(items, pa.int64()), "answer_share": pa.array(shares, pa.float64())}
                    )

    return run


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = 12, shard_items: int = SHARD_ITEMS, answer: str | None = None,
) -> DataFrame:
    """Rows ``doc_id, item_id``: the document holds ``n`` or more consecutive words of the item.

    Where items have an ``answer`` column beside their question (``item_text``), ``answer_share`` is added: the share of
    the answer's different words that the document holds, null without an answer. Null or empty texts match nothing, nor
    do items of fewer than ``n`` words. Documents with a null id are ignored; a document id that comes twice is reported
    once an item. Texts of any length are searched whole. Other columns are not read. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text"))
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    said = F.lit(None) if answer is None else items[answer]
    held = items.select(items[item_id].cast("bigint").alias("item_id"), items[item_text].cast("string").alias("text"), said.cast("string").alias("answer"))
    held = held.where("item_id IS NOT NULL AND text IS NOT NULL")
    total = held.count()
    shards = max(1, math.ceil(total / (shard_items * 0.8)))
    indexes = []
    for s in range(shards):
        part = held if shards == 1 else held.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s)
        rows = part.limit(2 * shard_items + 1).collect()
        if len(rows) > 2 * shard_items:
            raise ValueError("an index shard exceeds its bound; item ids repeat too often")
        indexes.append(spark.sparkContext.broadcast(Bm25Index([tuple(r) for r in rows], n)))
    out = docs.mapInArrow(_search(indexes), "doc_id bigint, item_id bigint, answer_share double")
    if answer is None:
        return out.select("doc_id", "item_id").distinct()
    return out.groupBy("doc_id", "item_id").agg(F.max("answer_share").alias("answer_share"))
