"""Rules that find domain concepts in text: patterns, token patterns, and all their matches with offsets.

A rule is (category, pattern). Patterns work on lower-cased text without accents. Token patterns (lists of attributes
``LOWER``, ``TEXT``, ``REGEX``, ``IN``, ``OP``) are compiled to the same form.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S


class Rule(NamedTuple):
    category: str
    pattern: str


#: The rules of the queries, an example: every operator takes others, for instance those of ``readers.token_rules``.
#: Patterns use only what Python, Java and RE2 share.
RULES = (
    Rule("CONSCIENCE", r"\b(?:inconscient|a perdu connaissance|ne repond plus|parle de facon confuse)"),
    Rule("CONSCIENCE", r"\b(?:tremble|convulse|fait un malaise)\b"),
    Rule("DETRESSE", r"\b(?:respire tres mal|mal a la poitrine|tousse)\b"),
    Rule("DETRESSE", r"\bvomit\b"),
    Rule("TRAUMATISME", r"\b(?:s'est coupe|s'est brule|saigne|cheville gonflee|se plaint du dos)\b"),
    Rule("TRAUMATISME", r"\b(?:tombe dans les escaliers|a glisse|a ete mordu|coince sous)\b"),
    Rule("INCENDIE", r"\b(?:fume|brule|fumee|explose|sent jusque)\b"),
    Rule("INCENDIE", r"\bodeur de gaz\b"),
    Rule("ACCIDENT", r"\b(?:renverse|demi-tour|contresens|verglas)\b"),
    Rule("LIEU", r"\b(?:mairie|pharmacie|boulangerie|gare|stade|piscine|tunnel|parking souterrain)\b"),
    Rule("LIEU", r"\bau (?:premier|deuxieme|troisieme) etage\b"),
    Rule("MOYENS", r"\b(?:ambulances?|fourgon pompe|lance a mousse|motopompe|echelle|vsav)\b"),
    Rule("MESURE", r"\b(?:mille|cent|[a-z]+) (?:metres|kilometres|minutes)\b"),
    Rule("AGE", r"\b(?:\d+|un|deux|trois|six|dix) (?:ans|mois)\b"),
    Rule("ROUTE", r"\b[adn] ?\d{1,4}\b"),
    Rule("CODE_POSTAL", r"\b\d{5}\b"),
    Rule("TELEPHONE", r"\b0[1-9](?:[ .-]?\d\d){4}\b"),
)


class _Folding(dict):
    def __missing__(self, code: int) -> str:
        base = unicodedata.normalize("NFD", chr(code))[0].lower()
        self[code] = base if len(base) == 1 else chr(code)
        return self[code]


_FOLD = _Folding()


def fold(text: str) -> str:
    """Lower case without accents, character for character."""
    return text.translate(_FOLD)


def compile_tokens(pattern: list[dict]) -> str:
    """A token pattern as a regular expression over space-separated folded tokens.

    An attribute value may be a string, ``{"REGEX": ...}`` or ``{"IN": [...]}``; ``OP`` may be ``?``, ``+`` or ``*``.
    """
    out = ""
    for token in pattern:
        value = next((token[k] for k in ("LOWER", "TEXT", "NORM") if k in token), None)
        if isinstance(value, dict) and "REGEX" in value:
            body = fold(value["REGEX"]).removeprefix("^").removesuffix("$")
        elif isinstance(value, dict) and "IN" in value:
            body = "|".join(re.escape(fold(x)) for x in value["IN"])
        else:
            body = re.escape(fold(value)) if value is not None else r"[^ ]+"
        # a whole token and the blank after it; find_spans trims the last one
        out += rf"(?:(?<![^ ])(?:{body})(?![^ ]) ?){token.get('OP', '')}"
    return out


_HEAD = (("category", S.StringType()), ("rule_no", S.IntegerType()), ("mot", S.StringType()))
SPAN = S.ArrayType(S.StructType([S.StructField(n, t) for n, t in (*_HEAD, ("start", S.IntegerType()), ("end", S.IntegerType()))]))
KEPT = S.ArrayType(S.StructType([S.StructField(n, t) for n, t in (*_HEAD, ("kept", S.BooleanType()))]))


@functools.lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]) -> tuple[tuple[str, re.Pattern], ...]:
    return tuple((r.category, re.compile(r.pattern)) for r in rules)


def find_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[dict]:
    """All matches of all rules, by rule and position in the NFC form of the text; empty matches are none."""
    if not text:
        return []
    folded = fold(unicodedata.normalize("NFC", text))
    out = []
    for n, (c, p) in enumerate(_compiled(rules)):
        for m in p.finditer(folded):
            mot = m.group().strip()
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            if mot:
                out.append({"category": c, "rule_no": n, "mot": mot, "start": start, "end": start + len(mot)})
    return out


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Column of all matches with offsets (``SPAN``)."""

    @F.pandas_udf(SPAN)
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda t: find_spans(t, rules))

    return udf(text)


def retained(ref: Column, hyp: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Per text pair the first match of each rule in ``ref`` and whether the rule also matches ``hyp``."""

    def one(r, h):
        r, h = fold(r or ""), fold(h or "")
        found = ((c, n, p, p.search(r)) for n, (c, p) in enumerate(_compiled(rules)))
        return [{"category": c, "rule_no": n, "mot": m.group().strip(), "kept": bool(p.search(h))} for c, n, p, m in found if m]

    @F.pandas_udf(KEPT)
    def udf(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        return pd.Series([one(r, h) for r, h in zip(ref, hyp)])

    return udf(ref, hyp)
