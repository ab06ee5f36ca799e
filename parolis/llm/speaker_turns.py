"""Transcript segments into clean, ordered speaker turns.

Per segment (map side, Arrow batches): one pass of an Aho-Corasick automaton over the folded text finds labels,
hesitations, stamps and sound annotations; context rules decide which matches stand; the text minus the matched
intervals gives the pieces, each with its speaker. Per call (windows): pieces go by time, and a turn begins where the
speaker changes. Windows run inside time slices of a call; slices meet through the last speaker and the number of
turns before them, so that a call with a tenth or a third of all rows is no single task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parolis.llm.lexicon import DETERMINERS, UND_IS_A_WORD, automaton, compose, fold, is_sound, parse_label, speaker_of

#: Width of a time slice in seconds.
SLICE_S = 600
#: Segment ids of one slice of segments that have no time.
UNTIMED = 10_000
#: Characters that the longest annotation in brackets may have.
LONGEST = 80

_CLOSERS = {"[": "]", "<": ">", "(": ")"}


def _past_blanks(folded: str, at: int) -> int:
    while at < len(folded) and folded[at] == " ":
        at += 1
    return at


def _matches(folded: str) -> tuple[list, list]:
    """Labels as (start, end, label start, label end) and cuts as (start, end, removable) after the context rules."""
    n = len(folded)
    labels, cuts = [], []
    for last, (kind, length, detail) in automaton().iter(folded):
        a, z = last - length + 1, last + 1
        if kind in ("sound", "stamp"):
            cuts.append((a, z, True))
            continue
        if kind == "open":  # a bracket: the shape of what it holds decides
            close = folded.find(detail, z, z + LONGEST)
            inside = folded[z:close] if close >= 0 else ""
            if inside and detail not in inside and "\n" not in inside and parse_label(inside) is None:
                before = folded[:a].rstrip(" ")[-1:] if a < 2 else folded[max(0, a - 8) : a].rstrip(" ")[-1:]
                alone = (not before or before in ".!?\n…:>]") and not folded[close + 1 : close + 3].lstrip(" ")[:1].isdigit()
                glued = a and folded[a - 1].isalnum()
                if not glued and is_sound(inside, folded[a:z], alone):
                    cuts.append((a, close + 1, True))
            continue
        if kind == "bare":  # a stamp without brackets is one at the head of a segment or line, with hours or decimals
            head = folded.rfind("\n", 0, a) + 1
            if length >= 7 and not folded[head:a].strip(" -") and folded[z : z + 1] in ("", " ", "\n") and not folded.startswith("-->", _past_blanks(folded, z)):
                cuts.append((a, z, True))
            continue
        if (a and (folded[a - 1].isalnum() or folded[a - 1] in "_@")) or (z < n and (folded[z].isalnum() or folded[z] in "_@")):
            continue  # inside a longer word
        if kind == "filler":
            if (a and folded[a - 1] == "'") or (z < n and folded[z] in "'-") or (a and folded[a - 1] == "-"):
                continue
            cuts.append((a, z, detail))
            continue
        before, after = a - 1, z
        while before >= 0 and folded[before] == " ":
            before -= 1
        while after < n and folded[after] == " ":
            after += 1
        if before >= 0 and after < n and _CLOSERS.get(folded[before]) == folded[after]:
            labels.append((before, after + 1, a, z))
            continue
        if after >= n or folded[after] not in ":>" or (after + 1 < n and folded[after + 1] == "/"):
            continue
        if before >= 0 and folded[before] == "'":
            continue
        if before >= 0 and "\n" not in folded[before + 1 : a] and folded[before].isalpha():
            w = before
            while w >= 0 and folded[w].isalpha():
                w -= 1
            if folded[w + 1 : before + 1] in DETERMINERS:
                continue  # "dit l'operateur : ..." is a sentence
        start = before if before >= 0 and folded[before] in "-–—" and (before == 0 or not folded[before - 1].isalnum()) else a
        labels.append((start, after + 1, a, z))
    # a bare digit before a colon names a speaker at the head of a segment or line, or in brackets
    head = 0
    for line in folded.split("\n"):
        body = line.lstrip(" -")
        at = head + len(line) - len(body)
        if body[:1] == "0" and body[1:].lstrip(" ")[:1] == ":" and not body[1:].lstrip(" ")[1:2].isdigit():
            labels.append((at, at + 1 + body[1:].index(":") + 1, at, at + 1))
        elif body[:1] in "[<" and body[1:2] == "0" and body[2:3] == _CLOSERS[body[:1]]:
            labels.append((at, at + 3, at + 1, at + 2))
        head += len(line) + 1
    # of overlapping labels ("op" in "op-sdis 1") the longest stands
    labels.sort(key=lambda x: (x[0], -(x[1] - x[0])))
    kept: list = []
    for x in labels:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept, cuts


def _subtract(text: str, folded: str, a: int, z: int, cuts: list) -> tuple[bool, str]:
    """Whether [a, z) holds content beyond the cut intervals, and its clean text."""
    spoken, hard, pos = False, [], a
    for s, e, removable in cuts[bisect.bisect_left(cuts, (a,)) :]:
        if s >= z:
            break
        if e > z:
            continue
        if s > pos and any(c.isalnum() for c in folded[pos:s]):
            spoken = True
        pos = max(pos, e)
        if removable:
            hard.append((s, e))
    if any(c.isalnum() for c in folded[pos:z]):
        spoken = True
    if not spoken:
        return False, ""
    german = sum(w in UND_IS_A_WORD for w in folded[a:z].split()) > 1
    out, pos = [], a
    for s, e in hard:
        if s < pos or (german and folded[s:e] == "und"):
            continue
        out.append(text[pos:s])
        while e < z and folded[e] in ",." and folded[s:e].isalpha():
            e += 1  # "euh, ..." and "euh... ..."
        pos = e
    out.append(text[pos:z])
    clean = " ".join("".join(out).split())
    return True, clean.strip(" ,;-–—") if clean[:1] in " ,;-–—" else clean


def split_pieces(text: str | None, speaker: str | None) -> list[tuple[str, str]]:
    """The (speaker, clean text) pieces of one segment in order; pieces without content are left out."""
    if text is None or not text.strip():
        return []
    text = compose(text)
    folded = fold(text)
    labels, cuts = _matches(folded)
    starts = [x[0] for x in labels]
    cuts.sort()

    def in_label(c: tuple) -> bool:
        i = bisect.bisect_left(starts, c[1])
        return i > 0 and labels[i - 1][1] > c[0]

    cuts = [c for c in cuts if not in_label(c)]
    bounds = [(speaker_of(speaker), 0, labels[0][0] if labels else len(text))]
    for i, (_, end, la, lz) in enumerate(labels):
        bounds.append((parse_label(text[la:lz]) or "inconnu", end, labels[i + 1][0] if i + 1 < len(labels) else len(text)))
    out = []
    for who, a, z in bounds:
        full, clean = _subtract(text, folded, a, z, cuts)
        if full:
            out.append((who, clean))
    return out


def _pieces(with_text: bool):
    kind = pa.list_(pa.struct([("speaker", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                [{"speaker": s, "text": t if with_text else None} for s, t in split_pieces(x, who)]
                for x, who in zip(b.column("text").to_pylist(), b.column("speaker").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("entity"), b.column("seg_id"), b.column("t"), pa.array(rows, kind)], ["entity", "seg_id", "t", "pieces"]
            )

    return run


def pieces(
    df: DataFrame, entity: str = "audio_id", seg_id: str = "seg_id", speaker: str = "speaker", text: str = "text",
    start: str = "start", words: str | None = "words", slice_s: int = SLICE_S, with_text: bool = True,
) -> DataFrame:
    """Clean pieces with turn marks: ``audio_id, seg_id, piece, speaker, text, t, slice, begins, turn_no``.

    ``t`` is the segment's start, else its earliest word start; segments without either go last. ``begins`` is 1 where a
    turn begins and ``turn_no`` numbers the turns of a call from 1. Without ``with_text`` the texts are read but not
    shuffled, and ``text`` is null.

    Rows with a null call or segment id are ignored; null, blank and noise-only text gives no piece; a segment delivered
    again counts once. Segments of equal time go by segment id. Other columns are not read. Empty tables give an empty
    result.
    """
    t = df[start].cast("double")
    if words is not None:
        t = F.coalesce(F.when(~F.isnan(t), t), F.array_min(F.transform(df[words], lambda w: w["start"].cast("double"))))
    rows = df.select(
        df[entity].cast("string").alias("entity"), df[seg_id].cast("bigint").alias("seg_id"),
        df[speaker].cast("string").alias("speaker"), df[text].cast("string").alias("text"), t.alias("t"),
    ).where("entity IS NOT NULL AND seg_id IS NOT NULL")
    kind = "entity string, seg_id bigint, t double, pieces array<struct<speaker: string, text: string>>"
    parts = rows.mapInArrow(_pieces(with_text), kind).where(F.size("pieces") > 0)
    # segments without any time go last, in order of id, in slices of ids; never null, so that both sides of the join
    # below read the same exchange
    parts = parts.withColumn("slice", F.coalesce(F.floor(F.col("t") / slice_s), F.lit(2**61) + F.floor(F.col("seg_id") / UNTIMED), F.lit(2**62)))

    # one exchange: everything below until the joins is grouped by (call, slice)
    parts = parts.repartition("entity", "slice")
    parts = parts.groupBy("entity", "slice", "seg_id").agg(F.min(F.struct("t", "pieces")).alias("x"))
    p = parts.select("entity", "slice", "seg_id", F.col("x.t").alias("t"), F.posexplode("x.pieces").alias("piece", "p"))
    p = p.select("entity", "slice", "seg_id", "t", "piece", F.col("p.speaker").alias("speaker"), F.col("p.text").alias("text"))

    order = [F.col("t").asc_nulls_last(), F.col("seg_id"), F.col("piece")]
    in_slice = Window.partitionBy("entity", "slice").orderBy(*order)
    p = p.withColumn("nth", F.row_number().over(in_slice)).withColumn("prev", F.lag("speaker").over(in_slice))
    p = p.withColumn("changes", (F.col("prev").isNotNull() & (F.col("prev") != F.col("speaker"))).cast("bigint"))
    p = p.withColumn("changes", F.sum("changes").over(in_slice))

    ends = p.groupBy("entity", "slice").agg(
        F.min_by("speaker", "nth").alias("first"), F.max_by("speaker", "nth").alias("last"), F.max("changes").alias("n")
    )
    along = Window.partitionBy("entity").orderBy("slice")
    ends = ends.withColumn("fresh", F.coalesce((F.lag("last").over(along) != F.col("first")).cast("bigint"), F.lit(1)))
    upto = F.sum(F.col("n") + F.col("fresh")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("entity", "slice", "fresh", F.coalesce(upto, F.lit(0)).alias("before"))

    p = p.join(ends, ["entity", "slice"])
    begins = F.when(F.col("nth") == 1, F.col("fresh")).otherwise((F.col("prev") != F.col("speaker")).cast("bigint"))
    return p.select(
        F.col("entity").alias("audio_id"), "seg_id", "piece", "speaker", "text", "t", "slice", begins.cast("int").alias("begins"),
        (F.col("before") + F.col("fresh") + F.col("changes")).alias("turn_no"),
    )


def turn_heads(df: DataFrame, **columns) -> DataFrame:
    """One row per turn at the segment where it begins: ``audio_id, seg_id, turn_in_seg, speaker, turn_no``."""
    p = pieces(df, with_text=False, **columns)
    w = Window.partitionBy("audio_id", "slice", "seg_id").orderBy("piece")
    heads = p.where("begins = 1").withColumn("turn_in_seg", F.row_number().over(w))
    return heads.select("audio_id", "seg_id", "turn_in_seg", "speaker", "turn_no")


def speaker_turns(df: DataFrame, **columns) -> DataFrame:
    """Whole turns: ``audio_id, turn_no, speaker, seg_id, n_pieces, text``, the text being the pieces' joined in order.

    A turn is as long as its speaker keeps speaking; only its own pieces meet in one row. Edge cases as in
    :func:`pieces`.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("t", F.lit(1e300)).alias("t"), "seg_id", "piece", "text")))
    turns = pieces(df, **columns).groupBy("audio_id", "turn_no").agg(
        F.first("speaker").alias("speaker"), parts.alias("parts")
    )
    return turns.select(
        "audio_id", "turn_no", "speaker", F.col("parts")[0]["seg_id"].alias("seg_id"), F.size("parts").alias("n_pieces"),
        F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"),
    )
