"""Talk time kept up to date over a stream of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parolis.operators.turns import call_id, speaker_key


def talk_time(turns: DataFrame, lateness: str = "60 days", window: str = "1 day") -> DataFrame:
    """Turns and seconds per call, speaker and window of loading time; rows later than ``lateness`` are dropped, which
    bounds the state. Works on streaming and on static turns alike."""
    t = turns.where("file IS NOT NULL AND speaker IS NOT NULL AND end > start AND loaded_at IS NOT NULL")
    t = t.withWatermark("loaded_at", lateness)
    by = (F.window("loaded_at", window), call_id(F.col("file")).alias("audio_id"), speaker_key(F.col("speaker")).alias("speaker"))
    out = t.groupBy(*by).agg(F.count("*").alias("n_turns"), F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return out.select(F.col("window.start").alias("window_start"), "audio_id", "speaker", "n_turns", "seconds")
