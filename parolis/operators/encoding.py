"""Embeddings of audio segments by a pluggable encoder, and the decision whether cleaning a recording helped.

An encoder is a factory called once a worker; it returns a function from mono samples to a vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parolis.functions import audio

Encoder = Callable[[np.ndarray], np.ndarray]
MODES = ("standard", "vad", "top_k", "weighted", "multi_frames")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(np.linalg.norm(v), 1e-12)


def encode(x: np.ndarray, fs: int, encoder: Encoder, mode: str = "vad", max_seconds: float = 10.0, frames: int = 3, frame_seconds: float = 3.0) -> np.ndarray:
    """Unit vector of one signal. ``standard`` takes its middle, ``vad`` the stretch densest in speech, ``top_k`` its
    loudest 40 % of frames, ``weighted`` the signal scaled by frame energy, ``multi_frames`` the mean over spread parts."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    x = audio.preprocess(x, fs)
    frame, hop = int(audio.FRAME * fs), int(audio.HOP * fs)
    energy = audio.frame_energies(x, fs)
    if mode == "multi_frames":
        n = int(frame_seconds * fs)
        starts = [0] if len(x) <= n else np.linspace(0, len(x) - n, frames).astype(int)
        return _unit(np.mean([_unit(encoder(x[a : a + n])) for a in starts], axis=0))
    if mode == "vad" and len(energy) and len(x) > int(3 * fs):
        a = audio.densest_zone(audio.speech_frames(x, fs), fs) * hop
        x = x[a : a + int(3 * fs)]
    elif mode == "top_k" and len(energy):
        k = max(1, int(0.4 * len(energy)))
        best = np.sort(np.argsort(-energy, kind="stable")[:k])
        x = np.concatenate([x[i * hop : i * hop + frame] for i in best])
    elif mode == "weighted" and len(energy):
        gain = np.interp(np.arange(len(x)), np.arange(len(energy)) * hop + frame / 2, energy / max(energy.max(), 1e-12))
        x = x * gain
    n = int(max_seconds * fs)
    if len(x) > n:
        x = x[(len(x) - n) // 2 :][:n]
    return _unit(np.asarray(encoder(x), dtype=np.float64))


def segment_vectors(recordings: DataFrame, cuts: DataFrame, factory: Callable[[], Encoder], fs: int = 16_000, mode: str = "standard", least_seconds: float = 1.0) -> DataFrame:
    """``file, utt_id, v`` of the pieces ``cuts`` (``file, utt_id, start, end`` in seconds) of ``recordings`` (``file,
    samples``); pieces shorter than ``least_seconds`` are left out. A recording is cut before it reaches the encoder."""
    c = cuts.where(F.col("end") - F.col("start") >= least_seconds)
    a, z = F.floor(F.col("start") * fs).cast("int"), F.floor(F.col("end") * fs).cast("int")
    pieces = recordings.join(c, "file").select("file", "utt_id", F.slice("samples", a + 1, z - a).alias("x")).where(F.size("x") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            yield pd.DataFrame({"file": b["file"], "utt_id": b["utt_id"], "v": [encode(np.asarray(x), fs, model, mode) for x in b["x"]]})

    return pieces.mapInPandas(run, "file string, utt_id string, v array<double>")


def gate_decision(snr: Column, raw_deviation: Column, clean_deviation: Column, gate_db: float = audio.GATE_DB) -> Column:
    """``clean`` at or above the gate; below it ``improved`` where the cleaned version's vectors spread less, ``degraded``
    where not, ``error`` where there is none."""
    return F.when(snr >= gate_db, "clean").when(clean_deviation.isNull(), "error").when(clean_deviation < raw_deviation, "improved").otherwise("degraded")


def window_stability(recordings: DataFrame, factory: Callable[[], Encoder], fs: int = 16_000) -> DataFrame:
    """``file, mean_sim, deviation, n_windows`` of each recording's analysis windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            out = []
            for name, s in zip(b["file"], b["samples"]):
                x = audio.preprocess(np.asarray(s), fs, emphasis=None)
                parts = audio.windows(len(x), fs, audio.speech_frames(x, fs)) if len(x) else []
                v = np.array([model(x[a:z]) for a, z in parts])
                out.append((name, *audio.stability(v), len(parts)))
            yield pd.DataFrame(out, columns=["file", "mean_sim", "deviation", "n_windows"])

    return recordings.select("file", "samples").mapInPandas(run, "file string, mean_sim double, deviation double, n_windows int")


def validity(duration: Column, speech_ratio: Column, quality: Column) -> Column:
    """Whether a signal is long enough, has speech and quality enough to take part in a classification."""
    return (duration >= 1.0) & (speech_ratio >= 0.1) & (quality >= 0.1)


def speaker_type(name: Column) -> Column:
    """Kind of speaker that a file or track name says; the first that fits."""
    return F.when(name.contains("Requerant"), "Requerant").when(name.contains("OP-SDIS1"), "OP-SDIS1").when(name.contains("Intervenant"), "Intervenant").otherwise("autre")
