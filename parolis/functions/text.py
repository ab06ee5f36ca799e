"""Text normalisation as column expressions, and the exact string measures that need Python (Arrow-batched)."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

# The hesitations ("disfluences") that detection ignores.
DISFLUENCIES = (
    "ah", "aie", "atchoum", "baf", "bah", "be", "ben", "bien", "bof", "bon ben", "bouh", "euh", "euf", "ha", "heu",
    "heueu", "he", "he bien", "hein", "hi", "ih", "hm", "hop", "hou", "hum", "hup", "la", "mah", "menfin", "mmm",
    "mouais", "moui", "of", "oh", "ok", "okay", "ouah", "ouais", "ouf", "ouille", "pff", "pouh", "snif", "tac", "toc",
    "wahou", "yeah", "zut", "zou", "und",
)

# Annotations that are only noise, and the noise tags removed inside others.
NOISE_ONLY = ("bruit", "und", "[bruit]", "<bruit>", "(bruit)")
NOISE_TAGS = r"(?iU)\bund\b|\[bruit\]|\(bruit\)|<bruit>"


def _latin_pairs() -> tuple[str, str]:
    """Letters with accents of the Latin blocks and what they decompose to."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            src.append(chr(code))
            dst.append(base[0])
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _latin_pairs()


def strip_accents(c: Column) -> Column:
    """NFD without combining marks, for Latin text; ligatures such as oe stay."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_display(c: Column) -> Column:
    """Lower case, everything that is no word character as one space; accents and hesitations stay."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " "))


def folded_words(c: Column) -> Column:
    """Lower case without accents and punctuation, one blank between words."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(c)), r"(?U)\W+", " "))


def normalize_detect(c: Column, disfluencies: tuple[str, ...] = DISFLUENCIES) -> Column:
    """Lower case without accents, punctuation and hesitations."""
    x = folded_words(c)
    words = "|".join(sorted(disfluencies, key=len, reverse=True))
    return squeeze(F.regexp_replace(x, rf"(?<![^ ])(?:{words})(?![^ ])", " "))


def clean_annotation(c: Column) -> Column:
    """Annotation text without noise; noise-only and empty text is null."""
    x = F.trim(c)
    kept = F.when(~F.lower(x).isin(*NOISE_ONLY), squeeze(F.regexp_replace(x, NOISE_TAGS, "")))
    return F.when(F.length(kept) > 0, kept)


def trim_elided(c: Column) -> Column:
    """Without a single elided letter left at the end ("eris c")."""
    return F.trim(F.regexp_replace(c, r"\s+(c|qu|l|d|s|m|t|n|j)$", ""))


def ratio(a: str | None, b: str | None) -> float | None:
    """Ratcliff-Obershelp similarity 2M / (len a + len b)."""
    return None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def edits(ref: list[str], hyp: list[str]) -> int:
    """Least number of word insertions, deletions and substitutions between two sequences."""
    if not ref or not hyp:
        return len(ref) + len(hyp)
    codes = {w: i for i, w in enumerate(dict.fromkeys([*ref, *hyp]))}
    h = np.array([codes[w] for w in hyp])
    row = np.arange(len(h) + 1)
    steps = np.arange(len(h) + 1)
    for w in ref:
        best = np.minimum(row[:-1] + (h != codes[w]), row[1:] + 1)
        # insertions run along the row: prefix minimum of best - position
        row = np.minimum.accumulate(np.concatenate(([row[0] + 1], best)) - steps) + steps
    return int(row[-1])


@F.pandas_udf(IntegerType())
def word_edits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edits between two texts split at blanks; a null text counts as empty."""
    return pd.Series([edits((r or "").split(), (h or "").split()) for r, h in zip(ref, hyp)], dtype="int32")
