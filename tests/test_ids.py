"""Ids that are not built are not registered, and those built since are no other operator's result."""

from __future__ import annotations

import pytest

from factloom.plans import registry


def test_unbuilt_ids():
    assert not {"D06", "D15"} & (set(registry.queries()) | set(registry.oracle_sql()))


@pytest.mark.parametrize("name", ["M-RC-CONSTRAINED", "M-TAU-ACCEPT", "G-INDUCED", "G-VERIFY", "H-NEIGHBORS", "M-MCNEMAR-JOINT", "F-HASH-ID-VARIANTS", "F-RANDOM"])
def test_built_ids_are_their_own(name):
    queries, sql = registry.queries(), registry.oracle_sql()
    assert [k for k, q in queries.items() if q is queries[name]] == [name] and [k for k, q in sql.items() if q == sql[name]] == [name]
