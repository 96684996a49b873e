from __future__ import annotations

from datetime import datetime as dt

from factloom.operators.orphans import Reference, Target, orphan_references, orphan_report

REF, KEY, DEAD = "k string, ingested_at timestamp_ntz, extra string", "id string, ingested_at timestamp_ntz", "target_table string, record_id string, deleted_at timestamp_ntz"


def run(spark, refs, keys, dead):
    return orphan_references(
        [Reference("child", spark.createDataFrame(refs, REF), "k", "parent")], [Target("parent", spark.createDataFrame(keys, KEY), "id")], spark.createDataFrame(dead, DEAD)
    )


def test_reasons(spark):
    jan, feb, feb2, mar = dt(2022, 1, 5), dt(2022, 2, 5), dt(2022, 2, 20), dt(2022, 3, 5)
    refs = [("gone", jan, ""), ("gone", feb, ""), ("gone", mar, ""), ("none", jan, ""), ("none", jan, ""), ("late", jan, ""), ("late", mar, ""), ("fine", mar, ""), (None, jan, ""), ("none", None, "")]
    keys = [("gone", jan), ("late", feb), ("late", mar), ("fine", jan), (None, jan)]
    out = run(spark, refs, keys, [("parent", "gone", feb2), ("parent", "gone", mar), ("other", "fine", jan), ("parent", None, jan)])
    assert {tuple(r) for r in out.collect()} == {
        ("child", "gone", "2022-03", "deleted"), ("child", "none", "2022-01", "missing"), ("child", "none", None, "missing"), ("child", "late", "2022-01", "late"),
    }
    assert orphan_report(out).count() == 4


def test_two_reasons_in_one_month_and_equal_times(spark):
    a, b = dt(2022, 1, 5), dt(2022, 1, 20)
    out = run(spark, [("x", a, ""), ("x", b, ""), ("y", a, "")], [("y", a)], [("parent", "x", b), ("parent", "y", a)])
    assert {tuple(r)[1:] for r in out.collect()} == {("x", "2022-01", "missing"), ("x", "2022-01", "deleted"), ("y", "2022-01", "deleted")}


def test_empty(spark):
    assert run(spark, [], [], []).count() == 0
