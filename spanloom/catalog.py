"""Registry of the core's queries and their SQL twins."""

from __future__ import annotations

from spanloom.plans import codecs, formats, general, intervals, sequence, stats

_FAMILIES = [intervals, stats, sequence, codecs, formats, general]


def queries() -> dict:
    return {k: v for m in _FAMILIES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _FAMILIES for k, v in m.ORACLE.items()}
