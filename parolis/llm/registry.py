"""All queries of the training-data operators by name."""

from __future__ import annotations

from parolis.llm.queries import leaks, mixing, nearest, neighbours, redaction, spans, turns

_MODULES = [turns, redaction, nearest, neighbours, leaks, mixing, spans]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.SQL
    return out
