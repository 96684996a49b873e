"""All queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from factloom.llm import queries as found

MODULES = [found]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
