"""Pages have agreement, passes have reliability, and consensus stands beside the reference."""

from __future__ import annotations

from factloom.llm import queries
from factloom.llm.consensus import item_agreement, named_or_not, naming_votes


def test_naming_votes(spark):
    passes = spark.createDataFrame([(1, v) for v in (1, 1, 2, 3, 4)] + [(2, 1)], "page long, vote int")
    naming = spark.createDataFrame([(1, 1, "A"), (1, 1, "A"), (1, 2, "A"), (1, 3, "A"), (1, 1, "B"), (1, 2, "B"), (2, 1, "C")], "page long, vote int, e string")
    v = naming_votes(passes, naming, "page", "vote", "e").selectExpr("concat(item, label) as item", "rater", "said as label")
    got = {r["item"]: (r["n_votes"], r["consensus"], r["consensus_share"], r["pair_agreement"]) for r in item_agreement(v, named_or_not(v)).collect()}
    assert got == {"1A": (4, "named", 0.75, 0.5), "1B": (4, "not_named", 0.5, 0.333333), "2C": (1, "named", 1.0, None)}


def test_compared(spark):
    best = spark.createDataFrame([("t1", "BOTH_WRONG"), ("t2", "BOTH_WRONG")], "item string, consensus string")
    held = [("t1", "BOTH_WRONG", "strong"), ("t1", "BOTH_WRONG", "strong"), ("t2", None, "weak"), ("t3", "AFTER_BETTER", None), ("t4", None, None)]
    got = {r["item_id"]: r["agrees"] for r in queries.compared(best, spark.createDataFrame(held, "task_id string, reference_label string, consensus_tier string")).collect()}
    assert got == {"t1": True, "t2": None, "t3": False}


def test_passes_are_in_the_queries(spark, sf):
    assert any(r["rater_id"].startswith("pass ") for r in queries.p7_raters(spark, sf).collect())
    rows = queries.p7_agreement(spark, sf).filter("entity_id is not null")
    found = {(r["item_id"], r["label"]) for r in queries.p7_found(spark, sf).filter("label like 'ENT%'").collect()}
    assert {(r["item"], r["entity_id"]) for r in rows.filter("consensus = 'named'").collect()} == found and found
