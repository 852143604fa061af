"""All registered queries of the record operators and their SQL."""

from __future__ import annotations

from . import derived, extra, more, relational, scalars, schemaless, scoring, selection, streams

MODULES = (scalars, relational, streams, more, extra, scoring, selection, schemaless, derived)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
