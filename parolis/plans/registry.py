"""All queries of the core library by name."""

from __future__ import annotations

from parolis.plans import audio, entities, intervals, overlap, similarity, turns

_MODULES = [similarity, turns, overlap, intervals, entities, audio]

FLAGSHIP = "profile_topk_intra"


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
