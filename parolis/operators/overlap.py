"""Joins of intervals of one call: attribution by greatest overlap, words in a window, diarisation error.

Every join has the call as its key and, because a call may hold a large part of all rows, a time slice besides: an
interval stands in each slice it touches and a pair counts in the slice where its overlap begins, so each pair is formed
once and no call is a single task.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time slice in the unit of the intervals (seconds).
SLICE = 60.0


def overlapping(left: DataFrame, right: DataFrame, width: float = SLICE, margin: float = 0.0) -> DataFrame:
    """Pairs of ``left`` (``audio_id, s, e, ...``) and ``right`` (``audio_id, rs, re, ...``) with ``rs < e + margin`` and
    ``re > s - margin``. All columns of both sides are kept; names must differ except for ``audio_id``."""
    a = left.withColumn("slice", F.explode(F.sequence(F.floor((F.col("s") - margin) / width), F.floor((F.col("e") + margin) / width))))
    b = right.withColumn("slice", F.explode(F.sequence(F.floor(F.col("rs") / width), F.floor(F.col("re") / width))))
    joined = a.join(b, ["audio_id", "slice"])
    meets = (F.col("rs") < F.col("e") + margin) & (F.col("re") > F.col("s") - margin)
    first = F.floor(F.greatest(F.col("s") - margin, F.col("rs")) / width) == F.col("slice")
    return joined.where(meets & first).drop("slice")


def attribute_speaker(entities: DataFrame, turns: DataFrame, default: str = "INCONNU", width: float = SLICE) -> DataFrame:
    """The speaker whose turn overlaps each entity (``audio_id, entity_id, s, e``) most; of equal overlaps the earlier
    turn. Entities in no turn get ``default``: ``entity_id, speaker, overlap``."""
    pairs = overlapping(entities.select("audio_id", "entity_id", "s", "e"), turns.select("audio_id", "speaker", F.col("start").alias("rs"), F.col("end").alias("re")), width)
    shared = F.round(F.least("e", "re") - F.greatest("s", "rs"), 6)
    best = pairs.withColumn("overlap", shared).groupBy("entity_id").agg(
        F.max(F.struct("overlap", (-F.col("rs")).alias("k"), (-F.col("re")).alias("k2"), "speaker")).alias("x")
    )
    out = entities.select("entity_id").join(best, "entity_id", "left")
    return out.select(
        "entity_id", F.coalesce("x.speaker", F.lit(default)).alias("speaker"), F.coalesce("x.overlap", F.lit(0.0)).alias("overlap")
    )


def words_in_window(segments: DataFrame, words: DataFrame, margin: float = 0.0, width: float = SLICE) -> DataFrame:
    """Words overlapping each segment widened by ``margin``: ``entity_id, n_words, text`` in order of time."""
    pairs = overlapping(segments.select("audio_id", "entity_id", "s", "e"), words.select("audio_id", "rs", "re", "word", "word_no"), width, margin)
    ordered = F.array_sort(F.collect_list(F.struct("rs", "re", "word_no", "word")))
    got = pairs.groupBy("entity_id").agg(F.count("*").alias("n_words"), F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("text"))
    out = segments.select("entity_id").join(got, "entity_id", "left")
    return out.select("entity_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("text", F.lit("")).alias("text"))


def _clipped(df: DataFrame, seconds: float) -> DataFrame:
    out = df.withColumn("start", F.greatest("start", F.lit(0.0))).withColumn("end", F.least("end", F.lit(seconds)))
    return out.where("end > start")


def elementary(reference: DataFrame, hypothesis: DataFrame, seconds: float = 240.0) -> DataFrame:
    """Per call the stretches between neighbouring boundaries of both sides in [0, ``seconds``], with the speakers active
    in each: ``audio_id, a, b, refs, hyps`` (sorted arrays)."""
    ref, hyp = _clipped(reference, seconds), _clipped(hypothesis, seconds)
    both = ref.select("audio_id", "speaker", "start", "end", F.lit(0).alias("side")).unionByName(
        hyp.select("audio_id", "speaker", "start", "end", F.lit(1).alias("side"))
    )
    # boundaries of a call are bounded by the region, whatever the length of the call
    points = both.select("audio_id", F.explode(F.array("start", "end")).alias("a")).distinct()
    cuts = points.withColumn("b", F.lead("a").over(Window.partitionBy("audio_id").orderBy("a"))).where("b IS NOT NULL")
    active = cuts.withColumnsRenamed({"a": "s", "b": "e"}).join(
        both.select("audio_id", "speaker", F.col("start").alias("rs"), F.col("end").alias("re"), "side"), "audio_id"
    ).where("rs < e AND re > s")
    side = lambda n: F.array_sort(F.collect_set(F.when(F.col("side") == n, F.col("speaker"))))
    return active.groupBy("audio_id", F.col("s").alias("a"), F.col("e").alias("b")).agg(side(0).alias("refs"), side(1).alias("hyps"))


def detection_errors(reference: DataFrame, hypothesis: DataFrame, seconds: float = 240.0) -> DataFrame:
    """Per call the parts of the diarisation error that need no speaker mapping, in seconds: ``total`` reference speech,
    ``missed`` and ``false_alarm`` (each speaker of an overlap counts)."""
    x = elementary(reference, hypothesis, seconds)
    d, n, h = F.col("b") - F.col("a"), F.size("refs"), F.size("hyps")
    return x.groupBy("audio_id").agg(
        F.sum(d * n).alias("total"), F.sum(d * F.greatest(n - h, F.lit(0))).alias("missed"),
        F.sum(d * F.greatest(h - n, F.lit(0))).alias("false_alarm"),
    )


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) of greatest total gain (Hungarian method with potentials)."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v, way, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            cur = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = cur < low[free]
            low[free[better]], way[free[better]] = cur[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(j, i) for i, j in pairs] if flip else pairs


def _confusion(pdf: pd.DataFrame) -> pd.DataFrame:
    refs = sorted(set(itertools.chain.from_iterable(pdf["refs"])))
    hyps = sorted(set(itertools.chain.from_iterable(pdf["hyps"])))
    shared = np.zeros((len(refs), len(hyps)))
    for d, r, h in zip(pdf["b"] - pdf["a"], pdf["refs"], pdf["hyps"]):
        for x in r:
            for y in h:
                shared[refs.index(x), hyps.index(y)] += d
    mapped = {hyps[j]: refs[i] for i, j in assignment(shared) if shared[i, j] > 0} if refs and hyps else {}
    total = missed = extra = wrong = 0.0
    for d, r, h in zip(pdf["b"] - pdf["a"], pdf["refs"], pdf["hyps"]):
        right = len({mapped.get(y) for y in h} & set(r))
        total += d * len(r)
        missed += d * max(0, len(r) - len(h))
        extra += d * max(0, len(h) - len(r))
        wrong += d * (min(len(r), len(h)) - right)
    der = (missed + extra + wrong) / total if total else None
    return pd.DataFrame([[pdf["audio_id"].iloc[0], total, missed, extra, wrong, der]], columns=["audio_id", "total", "missed", "false_alarm", "confusion", "der"])


def diarisation_error(reference: DataFrame, hypothesis: DataFrame, seconds: float = 240.0) -> DataFrame:
    """``audio_id, total, missed, false_alarm, confusion, der`` in the first ``seconds`` of each call, after the
    one-to-one speaker mapping of greatest shared time. ``der`` is null without reference speech. A call's rows are bounded by the region."""
    schema = "audio_id string, total double, missed double, false_alarm double, confusion double, der double"
    return elementary(reference, hypothesis, seconds).groupBy("audio_id").applyInPandas(_confusion, schema)
