"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from factloom.plans import registry
from util import assert_same

NAMES = sorted(registry.queries())


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, duck):
    df = registry.queries()[name](spark, sf)
    if name in registry.oracle_sql():
        assert_same(df, duck, registry.oracle_sql()[name])
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
