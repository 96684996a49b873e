"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from factloom.plans import analytics, competency, curation, further, general, relational

MODULES = [general, competency, relational, analytics, curation, further]
FLAGSHIP = competency.cq20


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
