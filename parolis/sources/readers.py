"""Readers of the domain's file formats. All schemas are explicit; a malformed row is skipped or raised as stated."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURNS = "files array<struct<file: string, turns: array<struct<speaker: string, start: double, end: double>>>>"
ASR = "segments array<struct<start: double, end: double, text: string, words: array<struct<word: string, start: double, end: double>>>>"
CLUSTER = "reference_utilisee string, seuil_intra_applique double, nombre_membres int, membres_cluster array<string>"


def diarisation_json(spark: SparkSession, path: str) -> DataFrame:
    """``file, turn_no, speaker, start, end`` of diarisation documents; a speaker written as a number becomes text."""
    d = spark.read.schema(TURNS).json(path, multiLine=True)
    f = d.select(F.explode("files").alias("f")).select("f.file", F.posexplode("f.turns").alias("pos", "t"))
    return f.select("file", (F.col("pos") + 1).cast("bigint").alias("turn_no"), "t.speaker", "t.start", "t.end")


def turns_of_file(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Turns of one recording by exact name; unknown names give no rows."""
    return diarisation_json(spark, path).where(F.col("file") == name)


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of all recordings of diarisation documents, also those without turns."""
    d = spark.read.schema(TURNS).json(path, multiLine=True)
    return d.select(F.explode("files").alias("f")).select("f.file")


def asr_words(spark: SparkSession, path: str, missing_first: bool = True) -> DataFrame:
    """``file, segment_no, word_no, word, start, end`` of transcription documents. Missing times are 0 and so sort first;
    with ``missing_first=False`` words without both times are dropped."""
    d = spark.read.schema(ASR).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    s = d.select("file", F.posexplode("segments").alias("segment_no", "s"))
    w = s.select("file", "segment_no", F.posexplode("s.words").alias("word_no", "w"))
    w = w.select("file", "segment_no", "word_no", "w.word", "w.start", "w.end")
    return w.fillna(0.0, ["start", "end"]) if missing_first else w.where("start IS NOT NULL AND end IS NOT NULL")


def asr_full_text(words: DataFrame) -> DataFrame:
    """``file, text``: the words of :func:`asr_words` by start, then place."""
    parts = F.array_sort(F.collect_list(F.struct("start", "segment_no", "word_no", "word")))
    return words.groupBy("file").agg(F.array_join(F.transform(parts, lambda x: x["word"]), " ").alias("text"))


def eaf_annotations(spark: SparkSession, path: str, tiers: list[str] | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``file, tier, start, end, text, bucket`` (ms) of annotation documents. Annotations that name an unknown time slot
    are dropped; ``bucket`` is the lower-cased text, ``sans_valeur`` where empty. ``tiers`` selects, ``ignore`` leaves out."""
    slots = spark.read.format("xml").option("rowTag", "TIME_SLOT").schema("_TIME_SLOT_ID string, _TIME_VALUE bigint").load(path)
    slots = slots.select(F.col("_metadata.file_path").alias("file"), F.col("_TIME_SLOT_ID").alias("slot"), F.col("_TIME_VALUE").alias("ms"))
    leaf = "ANNOTATION array<struct<ALIGNABLE_ANNOTATION: struct<ANNOTATION_VALUE: string, _TIME_SLOT_REF1: string, _TIME_SLOT_REF2: string>>>"
    t = spark.read.format("xml").option("rowTag", "TIER").schema(f"_TIER_ID string, {leaf}").load(path)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.col("_TIER_ID").alias("tier"), F.explode("ANNOTATION").alias("a"))
    t = t.select("file", "tier", "a.ALIGNABLE_ANNOTATION.*").where("_TIME_SLOT_REF1 IS NOT NULL")
    if tiers is not None:
        t = t.where(F.col("tier").isin(*tiers))
    if ignore:
        t = t.where(~F.col("tier").isin(*ignore))
    first = slots.select("file", F.col("slot").alias("_TIME_SLOT_REF1"), F.col("ms").alias("start"))
    last = slots.select("file", F.col("slot").alias("_TIME_SLOT_REF2"), F.col("ms").alias("end"))
    x = t.join(first, ["file", "_TIME_SLOT_REF1"]).join(last, ["file", "_TIME_SLOT_REF2"])
    text = F.coalesce("ANNOTATION_VALUE", F.lit(""))
    bucket = F.coalesce(F.nullif(F.lower(F.trim(text)), F.lit("")), F.lit("sans_valeur"))
    return x.select("file", "tier", "start", "end", text.alias("text"), bucket.alias("bucket"))


def eaf_tiers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct tier names, sorted."""
    t = spark.read.format("xml").option("rowTag", "TIER").schema("_TIER_ID string").load(path)
    return t.select(F.col("_TIER_ID").alias("tier")).where("tier IS NOT NULL").distinct().orderBy("tier")


def elan_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``tier, annotator, start, end, text`` of tab exports, and the rejected lines (fewer than five columns)."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    parts = lines.withColumn("p", F.split("value", "\t"))
    good = parts.where(F.size("p") >= 5)
    names = ("tier", "annotator", "start", "end", "text")
    return good.select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)]), parts.where(F.size("p") < 5).select("value")


def embedding_text(spark: SparkSession, path: str) -> DataFrame:
    """``utt_id, v`` of lines ``utt_id|v1 v2 ...``. Blank lines, lines without a bar and lines with a value that is no
    number are skipped; of an id given again the last line counts."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("value"))
    x = lines.where(F.instr("value", "|") > 0).select("line_no", F.split("value", r"\|", 2).alias("p"))
    values = F.filter(F.split(F.col("p")[1], r"\s+"), lambda s: s != "")
    x = x.select("line_no", F.col("p")[0].alias("utt_id"), F.transform(values, lambda s: s.try_cast("double")).alias("v"))
    x = x.where((F.size("v") > 0) & ~F.exists("v", lambda d: d.isNull()))
    last = x.groupBy("utt_id").agg(F.max("line_no").alias("line_no"))
    return x.join(last, ["utt_id", "line_no"], "left_semi").select("utt_id", "v")


def embedding_text_strict(spark: SparkSession, path: str) -> DataFrame:
    """``utt_id, v`` of lines ``utt_id v1 v2 ...``; a line without values or with one that is no number is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    p = F.split("value", r"\s+")
    x = lines.select(p[0].alias("utt_id"), F.slice(p, 2, F.size(p)).alias("s"), "value")
    v = F.transform("s", lambda s: s.try_cast("double"))
    bad = (F.size("s") == 0) | F.exists(v, lambda d: d.isNull())
    return x.select("utt_id", F.when(bad, F.raise_error(F.concat(F.lit("malformed embedding line: "), "value"))).otherwise(v).alias("v"))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``place`` names of a GeoJSON (``nom_commune`` of its features) or a semicolon CSV with that header:
    trimmed, lower-cased, hyphens as blanks."""
    if path.endswith((".csv", ".txt")):
        names = spark.read.csv(path, sep=";", header=True).select("nom_commune")
    else:
        d = spark.read.schema("features array<struct<properties: struct<nom_commune: string>>>").json(path, multiLine=True)
        names = d.select(F.explode("features.properties.nom_commune").alias("nom_commune"))
    place = F.replace(F.lower(F.trim("nom_commune")), F.lit("-"), F.lit(" "))
    return names.where("nom_commune IS NOT NULL").select(place.alias("place")).where("place <> ''").distinct()


def token_rules(spark: SparkSession, path: str) -> list:
    """Rules of a JSON-lines file ``{"label", "pattern": [...]}`` compiled to patterns; small, goes to the driver."""
    import json

    from parolis.functions.rules import Rule, compile_tokens

    rows = [json.loads(r.value) for r in spark.read.text(path).where("trim(value) <> ''").collect()]
    return [Rule(r["label"], compile_tokens(r["pattern"])) for r in rows if isinstance(r.get("pattern"), list)]


def cluster_documents(spark: SparkSession, path: str) -> DataFrame:
    """``ref, threshold, target`` of cluster documents found in any sub-folder; of a reference given again the last file
    in order of path counts. References without members have a null target."""
    d = spark.read.schema(CLUSTER).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="cluster_locuteur_*.json")
    d = d.withColumn("file", F.col("_metadata.file_path"))
    w = Window.partitionBy("reference_utilisee").orderBy(F.desc("file"))
    d = d.withColumn("k", F.row_number().over(w)).where("k = 1")
    return d.select(F.col("reference_utilisee").alias("ref"), F.col("seuil_intra_applique").alias("threshold"), F.explode_outer("membres_cluster").alias("target"))


def segment_catalogue(spark: SparkSession, path: str, speaker: str | None = None) -> DataFrame:
    """``segment, discussion, ordinal`` of a catalogue's first tokens; blank lines and lines that begin with ``/`` are
    skipped. ``speaker`` keeps names that contain it. Sort by ``ordinal`` for the natural order."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' AND NOT startswith(value, '/')")
    name = F.split("value", r"\s+")[0]
    x = lines.select(F.replace(name, F.lit(".wav"), F.lit("")).alias("segment"))
    if speaker is not None:
        x = x.where(F.contains("segment", F.lit(speaker)))
    call = F.nullif(F.regexp_extract("segment", r"(audio-[\d.]+)", 1), F.lit(""))
    ordinal = F.regexp_extract("segment", r"(\d+)$", 1).try_cast("int")
    return x.select("segment", call.alias("discussion"), ordinal.alias("ordinal")).where("discussion IS NOT NULL")


def worklist(spark: SparkSession, path: str) -> DataFrame:
    """``file``: one name a line; blank lines and recordings that were improved already are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("file")).where("file <> '' AND NOT endswith(file, '_ameliore.wav')")


def wav_samples(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """``file, samples`` (mono, ``rate`` a second) of PCM WAV files in any sub-folder; unreadable files are skipped."""
    from parolis.functions.audio import read_wav

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"]):
                try:
                    rows.append((name, read_wav(content, rate)))
                except Exception:  # noqa: BLE001, S112
                    continue
            yield pd.DataFrame(rows, columns=["file", "samples"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(decode, "file string, samples array<double>")


def numpy_vectors(spark: SparkSession, path: str, contains: str | None = None) -> DataFrame:
    """``file, v`` of ``.npy`` vectors in any sub-folder, the portable stand-in for pickled tensors; ``contains`` filters
    by path, unreadable files are skipped."""
    import numpy as np

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"]):
                try:
                    rows.append((name, np.load(io.BytesIO(content), allow_pickle=False).astype("float64").ravel()))
                except Exception:  # noqa: BLE001, S112
                    continue
            yield pd.DataFrame(rows, columns=["file", "v"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    if contains is not None:
        files = files.where(F.contains("path", F.lit(contains)))
    return files.select("path", "content").mapInPandas(decode, "file string, v array<double>")


def find_vector(vectors: DataFrame, utt_id: str, exact: bool = True) -> DataFrame:
    """The vector of an id; with ``exact=False`` that of the first id, in order, that contains the text."""
    if exact:
        return vectors.where(F.col("utt_id") == utt_id)
    return vectors.where(F.contains("utt_id", F.lit(utt_id))).orderBy("utt_id").limit(1)
