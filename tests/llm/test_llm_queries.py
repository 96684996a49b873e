"""The subpackage's queries run on the smallest tables; those with SQL agree with it."""

from __future__ import annotations

import pytest

from factloom.llm import registry
from util import assert_same

COLUMNS = {
    "p1_found": ["id_a", "id_b"], "p5_found": ["record_id", "group_id"], "p6_found": ["id_a", "id_b"], "p7_found": ["item_id", "label"], "p8_ids": ["doc_id", "ids"],
    "p10_found": ["doc_id", "kind", "start_pos", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf, duck):
    df = registry.queries()[name](spark, sf)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in registry.oracle_sql():
        assert_same(df, duck, registry.oracle_sql()[name])
    else:
        df.collect()
