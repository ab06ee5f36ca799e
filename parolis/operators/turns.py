"""Diarisation turns: identifiers, ordinals, filters, talk time, cut lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_id(file: Column) -> Column:
    """Call identifier of a recording's file name: without folder and without ``.wav`` in any case."""
    return F.regexp_replace(F.regexp_replace(F.trim(file), r"^.*[/\\]", ""), r"(?i)\.wav$", "")


def speaker_key(speaker: Column) -> Column:
    """Trimmed, lower-cased speaker label."""
    return F.lower(F.trim(speaker))


#: Written names of speakers in exported files.
SPEAKER_NAMES = {"operateur": "OP-SDIS1", **{str(n): f"requerant{n}" for n in range(5)}}
#: Shortest turn kept by cleaning (longer than) and used for an embedding (at least), in seconds.
CLEAN_SECONDS, EMBED_SECONDS = 2.0, 1.0
#: Turn numbers of one slice of a call.
SLICE_TURNS = 1000


def valid_turns(turns: DataFrame) -> DataFrame:
    """``audio_id, turn_no, speaker, start, end, duration`` of turns with file, speaker and both times, end after start.

    Times are rounded to milliseconds; a row repeated with the same number counts once.
    """
    ms = lambda c: F.round(c, 3)
    t = turns.select(
        call_id(F.col("file")).alias("audio_id"), "turn_no", speaker_key(F.col("speaker")).alias("speaker"),
        ms(F.col("start")).alias("start"), ms(F.col("end")).alias("end"),
    ).where("audio_id IS NOT NULL AND speaker IS NOT NULL AND start IS NOT NULL AND end > start")
    return t.dropDuplicates().withColumn("duration", F.round(F.col("end") - F.col("start"), 3))


def _order() -> list:
    return [F.col("turn_no"), F.col("start"), F.col("end")]


def numbered(turns: DataFrame, keys: list[str], name: str, step: int = SLICE_TURNS) -> DataFrame:
    """Turns with their running number ``name`` among those of equal ``keys`` in turn order.

    Numbers are counted within ``step`` turn numbers and shifted by the counts of the slices before, one row a slice, so
    that a call with a large part of all turns is no single task. Turns without a number go first.
    """
    t = turns.withColumn("slice_", F.coalesce(F.floor(F.col("turn_no") / step), F.lit(-(2**62))))
    t = t.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys, "slice_").orderBy(*_order())))
    along = Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy(*keys, "slice_").agg(F.count("*").alias("n_"))
    before = sizes.select(*keys, "slice_", F.coalesce(F.sum("n_").over(along), F.lit(0)).alias("before_"))
    t = t.join(before, [*keys, "slice_"])
    return t.withColumn(name, (F.col("nth_") + F.col("before_")).cast("int")).drop("slice_", "nth_", "before_")


def with_ordinals(turns: DataFrame) -> DataFrame:
    """Running number of each speaker's turns in a call, over all turns, and ``utt_id = call_speaker_number``."""
    t = numbered(turns, ["audio_id", "speaker"], "ordinal")
    return t.withColumn("utt_id", F.concat_ws("_", "audio_id", "speaker", F.col("ordinal").cast("string")))


def by_count(turns: DataFrame) -> DataFrame:
    """``audio_id, n`` of all calls, those with the most turns first, ties by id."""
    return turns.groupBy("audio_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "audio_id")


def restricted(rows: DataFrame, column: str, allowed: list[str] | None) -> DataFrame:
    """Rows whose ``column`` is in a list of references; without a list, or with an empty one, all rows."""
    return rows.where(F.col(column).isin(*allowed)) if allowed else rows


def discussion_number(name: Column) -> Column:
    """The digits a file name begins with, else ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit("")), F.lit("unknown"))


def cleaned(turns: DataFrame, seconds: float = CLEAN_SECONDS, renumber: bool = False) -> DataFrame:
    """Turns longer than ``seconds``, strictly. Numbers are of all turns; ``renumber`` counts the kept ones instead."""
    long = F.col("duration") > seconds
    return with_ordinals(turns.where(long)) if renumber else with_ordinals(turns).where(long)


def valid_calls(turns: DataFrame, speaker: str = "operateur") -> DataFrame:
    """Calls with more than one turn of ``speaker``: ``audio_id, n_turns``."""
    return turns.where(F.col("speaker") == speaker).groupBy("audio_id").agg(F.count("*").alias("n_turns")).where("n_turns > 1")


def talk_time(turns: DataFrame) -> DataFrame:
    """Per call and speaker: number of turns and seconds of speech."""
    return turns.groupBy("audio_id", "speaker").agg(F.count("*").alias("n_turns"), F.sum("duration").alias("seconds"))


def duration_lists(turns: DataFrame) -> DataFrame:
    """Per call and speaker the durations (2 places) in turn order, joined by ``;``."""
    parts = F.array_sort(F.collect_list(F.struct("turn_no", "start", "end", F.format_string("%.2f", "duration").alias("d"))))
    return turns.groupBy("audio_id", "speaker").agg(
        F.count("*").alias("n_turns"), F.array_join(F.transform(parts, lambda x: x["d"]), ";").alias("durations")
    )


def named(speaker: Column) -> Column:
    """The exported name of a speaker; others are ``locuteur_<speaker>``."""
    names = F.create_map(*[F.lit(x) for kv in SPEAKER_NAMES.items() for x in kv])
    return F.coalesce(names[speaker], F.concat(F.lit("locuteur_"), speaker))


def cut_list(turns: DataFrame, rename: bool = True) -> DataFrame:
    """Pieces to cut from each recording: ``audio_id, speaker_name, seg_no, start_ms, end_ms, out_name``."""
    t = turns.withColumn("speaker_name", named(F.col("speaker")) if rename else F.col("speaker"))
    t = numbered(t, ["audio_id", "speaker_name"], "seg_no")
    safe = F.translate("speaker_name", " /", "__")
    return t.select(
        "audio_id", "speaker_name", "seg_no",
        F.floor(F.round(F.col("start") * 1000, 3)).cast("bigint").alias("start_ms"), F.floor(F.round(F.col("end") * 1000, 3)).cast("bigint").alias("end_ms"),
        F.concat(F.col("audio_id"), F.lit("_"), safe, F.lit("_"), F.col("seg_no").cast("string"), F.lit(".wav")).alias("out_name"),
    )


def speakers_of(turns: DataFrame) -> DataFrame:
    """Distinct speakers of a call in order, joined by commas."""
    return turns.groupBy("audio_id").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"))
