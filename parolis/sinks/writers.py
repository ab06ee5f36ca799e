"""Writers of the report contracts. Rendering (charts, console pages) is left to their readers; these are the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column titles of the similarity reports, by contract.
SIMPLE = {"type": "Type", "discussion_id": "ID Discussion", "n_segments": "Nb Segments", "mean_sim": "Similitude Moyenne"}
STATISTICS = {
    "type": "Type Analyse", "run": "Date Exécution", "speaker": "Locuteur Cible", "discussion_id": "ID Discussion", "n_segments": "Nb Segments",
    "n_pairs": "Paires Comparées", "mean_sim": "Similitude Moyenne", "min_sim": "Score Min", "max_sim": "Score Max", "std_sim": "Ecart-Type",
}
TOP_K = {
    "run": "Date Exécution", "speaker": "Locuteur Cible", "type": "Type Analyse", "discussion_id": "ID Discussion", "n_segments": "Nb Segments Total",
    "members": "ID du Profil (Top k)", "mean_sim": "Similitude Moyenne", "min_sim": "Score Min", "max_sim": "Score Max", "std_sim": "Ecart-Type",
}
TOP_K_CLUSTER = TOP_K | {"in_cluster": "Appartient au Cluster"}
LONGEST_K = {
    "type": "Type Analyse", "discussion_id": "ID Discussion", "mean_sim": "Score Similitude", "n_segments": "Segments Evalués (Total)",
    "members": "ID du Profil", "profile_seconds": "Durée Profil (sec)", "min_sim": "Score Min (Intra)", "max_sim": "Score Max (Intra)",
}


def run_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmm")


def similarity_csv(rows: DataFrame, path: str, contract: dict[str, str]) -> None:
    """One report file: the INTRA row first, then the others by descending similarity; numbers at 4 places, nulls N/A."""
    numbers = {c for c, t in rows.dtypes if t in ("double", "float")}
    ordered = rows.orderBy(F.when(F.col("type") == "INTRA", 0).otherwise(1), F.desc("mean_sim"), "discussion_id")
    cols = [F.coalesce(F.round(c, 4).cast("string") if c in numbers else F.col(c).cast("string"), F.lit("N/A")).alias(t) for c, t in contract.items()]
    ordered.select(*cols).coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True)


def similarity_report(intra: DataFrame, inter: DataFrame, ref: str, thresholds: DataFrame | None = None) -> DataFrame:
    """Rows of one reference in the common shape: its INTRA row and an INTER row a target; with ``thresholds``
    (``ref, threshold``) also whether each target belongs to the cluster."""
    own = intra.where(F.col("discussion") == ref).select(F.lit("INTRA").alias("type"), F.col("discussion").alias("discussion_id"), "n_segments", "members", "mean_sim", "min_sim", "max_sim", "std_sim")
    names = intra.select(F.col("discussion").alias("target"), "n_segments", "members")
    none = F.lit(None).cast("double")
    other = inter.where(F.col("ref") == ref).join(names, "target").select(
        F.lit("INTER").alias("type"), F.col("target").alias("discussion_id"), "n_segments", "members", F.col("sim").alias("mean_sim"),
        none.alias("min_sim"), none.alias("max_sim"), none.alias("std_sim"),
    )
    out = own.unionByName(other)
    if thresholds is None:
        return out
    level = thresholds.where(F.col("ref") == ref).select("threshold").limit(1)
    out = out.withColumn("threshold", level.scalar())
    flag = F.when(F.col("type") == "INTRA", "RÉFÉRENCE").when(F.col("mean_sim") > F.col("threshold"), "OUI").otherwise("NON")
    return out.withColumn("in_cluster", flag).drop("threshold")


def cluster_json(clusters: DataFrame, path: str) -> None:
    """Cluster documents, one line each, in a folder a reference."""
    doc = clusters.select(
        "ref", F.col("ref").alias("reference_utilisee"), F.col("threshold").alias("seuil_intra_applique"), F.col("n_members").cast("int").alias("nombre_membres"),
        F.when(F.col("members") == "", F.array().cast("array<string>")).otherwise(F.split("members", ",")).alias("membres_cluster"),
    )
    doc.write.mode("overwrite").partitionBy("ref").json(path)


def link_csv(network: DataFrame, path: str) -> None:
    """Links ``ref;target;rank;score;reciprocal`` with scores at 4 places and OUI or NON."""
    network.select("ref", "target", "rank", F.round("score", 4).alias("score"), F.when(F.col("reciprocal"), "OUI").otherwise("NON").alias("reciprocal")).orderBy("ref", "rank").coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True)


def matrix_csv(matrix: DataFrame, path: str) -> None:
    matrix.orderBy("ref").coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True)


def evaluation_json(outcomes: DataFrame, rates: DataFrame, path: str, insertions: DataFrame | None = None) -> None:
    """Per call ``audio_id, fichier_source, statistiques, details`` with the items of each outcome and, where given, the
    inserted words (``audio_id, word``)."""
    items = lambda s: F.collect_list(F.when(F.col("status") == s, F.struct("category", "mot", "perceived", "score")))
    details = outcomes.groupBy("audio_id").agg(F.struct(items("CORRECT").alias("correct"), items("SUBSTITUTION").alias("substitutions"), items("DELETION").alias("deletions")).alias("details"))
    if insertions is not None:
        added = insertions.groupBy("audio_id").agg(F.array_sort(F.collect_set("word")).alias("w"))
        none = F.array().cast("array<string>")
        details = details.join(added, "audio_id", "left").select("audio_id", F.struct("details.*", F.coalesce("w", none).alias("insertions")).alias("details"))
    stats = rates.select("audio_id", F.concat("audio_id", F.lit(".wav")).alias("fichier_source"), F.struct(*[c for c in rates.columns if c != "audio_id"]).alias("statistiques"))
    stats.join(details, "audio_id").write.mode("overwrite").json(path)


def entity_list(entities: DataFrame, path: str) -> None:
    """Entities ``audio_id, mot, category, speaker, start_s, end_s, source`` as ``mot, categorie, locuteur, debut_sec,
    fin_sec, source_detection``, one JSON line each, in order of time within a call; a folder a call."""
    x = entities.select(
        "audio_id", "mot", F.col("category").alias("categorie"), F.col("speaker").alias("locuteur"), F.round("start_s", 2).alias("debut_sec"),
        F.round("end_s", 2).alias("fin_sec"), F.col("source").alias("source_detection"),
    )
    x.repartition("audio_id").sortWithinPartitions("audio_id", "debut_sec", "mot").write.mode("overwrite").partitionBy("audio_id").json(path)


def classification_csv(decided: DataFrame, path: str) -> None:
    """Decisions ``utt_id, discussion, kind, score, same_speaker`` as ``Fichier,Discussion,Type,Score,Decision``."""
    said = F.when(F.col("same_speaker"), "MÊME LOCUTEUR").otherwise("LOCUTEUR DIFFÉRENT")
    x = decided.select(F.col("utt_id").alias("Fichier"), F.col("discussion").alias("Discussion"), F.col("kind").alias("Type"), F.col("score").alias("Score"), said.alias("Decision"))
    x.repartitionByRange("Fichier").sortWithinPartitions("Fichier").write.mode("overwrite").csv(path, header=True)


def classification_report(stats: DataFrame, path: str) -> None:
    """Statistics by kind (``kind, n, n_same, n_diff, pct_same``; the total has no kind) as lines of a text."""
    line = F.format_string("%-15s %8d %10d %12d %9.1f%%", F.coalesce("kind", F.lit("TOTAL")), "n", "n_same", "n_diff", "pct_same")
    rows = stats.select(F.col("kind").isNull().alias("last"), "kind", line.alias("value"))
    rows.orderBy("last", "kind").select("value").coalesce(1).write.mode("overwrite").text(path)  # a row a kind


def diarisation_json(turns: DataFrame, path: str) -> None:
    """Documents ``{"files": [{"file", "turns"}]}``, one a call, turns in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn_no", "start", "end", "speaker")))
    per_call = turns.groupBy("audio_id").agg(F.transform(parts, lambda x: F.struct(x["speaker"].alias("speaker"), x["start"].alias("start"), x["end"].alias("end"))).alias("turns"))
    per_call.select(F.array(F.struct(F.concat("audio_id", F.lit(".wav")).alias("file"), "turns")).alias("files")).write.mode("overwrite").json(path)


def embedding_text(vectors: DataFrame, path: str) -> None:
    """Lines ``utt_id|v1 v2 ...``."""
    values = F.array_join(F.transform("v", lambda x: x.cast("string")), " ")
    vectors.select(F.concat_ws("|", "utt_id", values).alias("value")).write.mode("overwrite").text(path)


def audacity_labels(rows: DataFrame, path: str) -> None:
    """Labels ``start, end, speaker`` by tabs, in a folder a speaker."""
    rows.select(F.col("tier").alias("speaker"), "start", "end", F.col("tier").alias("label")).write.mode("overwrite").partitionBy("speaker").csv(path, sep="\t")
