from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import evaluation
from factloom.plans import competency
from factloom.plans.contract import run_contract


@pytest.mark.parametrize(
    "left, right, code",
    [
        (("09-01", "09-30"), ("01-01", "01-31"), "after"), (("01-01", "01-31"), ("02-01", "03-01"), "before"), (("02-01", "03-01"), ("03-01", "04-15"), "meets"),
        (("03-01", "04-15"), ("03-15", "06-30"), "overlaps"), (("03-15", "06-30"), ("04-01", "04-30"), "contains"), (("03-15", "06-30"), ("03-15", "06-30"), "equals"),
        (("03-15", "06-30"), ("03-15", "12-31"), "starts"), (("03-15", "06-30"), ("01-01", "06-30"), "ends"), (("04-05", "04-25"), ("04-01", "04-30"), "during"),
    ],
)
def test_allen(spark, left, right, code):
    days = [date.fromisoformat(f"1938-{x}") for x in (*left, *right)]
    df = spark.createDataFrame([tuple(days)], "a date, b date, c date, d date")
    assert df.select(X.allen(*(F.col(x) for x in "abcd"))).first()[0] == code


def test_functions(spark):
    df = spark.createDataFrame([("year", "period", None), ("month", "year", "x")], "p string, q string, n string")
    assert [r[0] for r in df.select(X.coarser(F.col("p"), F.col("q"))).collect()] == ["period", "year"]
    one = df.select(X.stable_id("K", "p", "n").alias("a"), X.stable_id_nulls("K", F.col("p"), F.col("n")).alias("b"), X.stable_id_spaces("K", F.lit(" a  b "), F.col("p")).alias("c"), X.stable_id_spaces("K", F.lit("a b"), F.col("p")).alias("d")).first()
    assert one.a != one.b and one.c == one.d and len(one.a) == 26
    assert {r[0] for r in df.select(X.ab_order("s", F.col("p"))).collect()} <= {"AB", "BA"}


def test_isotonic_and_knee():
    # 0.25 joins 0.5 at 0.375; 0.3 is below that and joins it too, by the plain mean; 0.4 stays
    assert evaluation.single_pass_isotonic([(0.1, 0.5), (0.3, 0.25), (0.6, 0.3), (0.7, 0.4)]) == [(pytest.approx(0.4), pytest.approx(0.3375)), (0.7, 0.4)]
    assert evaluation.single_pass_isotonic([(0.1, 0.2), (0.3, 0.4)]) == [(0.1, 0.2), (0.3, 0.4)] and evaluation.single_pass_isotonic([]) == []
    assert evaluation.knee([(0, 0), (0.1, 0.8), (0.5, 0.9), (1, 1), (0.5, 0.1)]) == (0.1, 0.8) and evaluation.knee([]) is None


def test_poststratified(spark):
    s = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "h string, v double")
    r = evaluation.poststratified(s, spark.createDataFrame([("a", 30), ("b", 10), ("c", 60)], "h string, size long"), "h", "v").first()
    assert (r.estimate, r.covered, r.empty_strata) == (pytest.approx(25 / 40), 40, 1)


def test_matched_controls(spark):
    cases = spark.createDataFrame([("c1", "x", 1), ("c2", "x", 1), ("c3", "y", 2)], "id string, p string, q int")
    controls = spark.createDataFrame([("k1", "x", 1), ("k2", "x", 9), ("k3", "z", 2)], "id string, p string, q int")
    got = evaluation.matched_controls(cases, controls, [["p", "q"], ["p"]]).collect()
    assert len(got) == 2 and len({r["control"] for r in got}) == 2 and {r["level"] for r in got} == {0, 1} and not any(r["case"] == "c3" for r in got)


def test_frequent_rules(spark):
    rows = [(True, True, False, 1), (True, True, False, 1), (True, False, False, 0), (False, True, False, 0)]
    got = {r["rule"]: (r["support"], r["hits"]) for r in evaluation.frequent_rules(spark.createDataFrame(rows, "a boolean, b boolean, c boolean, t int"), ["a", "b", "c"], "t", 2).collect()}
    assert got == {"a": (3, 2), "b": (3, 2), "a&b": (2, 2)}
    assert evaluation.frequent_rules(spark.createDataFrame(rows, "a boolean, b boolean, c boolean, t int"), ["c"], "t", 2).count() == 0


def test_contract(spark, sf, tmp_path):
    required = {"CQ04": ["stage_order", "state_share"], "CQ20": ["research_tier"], "CQ22": ["space_role", "no_such"]}
    out = run_contract(spark, sf, competency.QUERIES, required, str(tmp_path / "r.json"))
    assert out["checks"]["CQ04 columns"] and out["checks"]["CQ04 rows"] and not out["checks"]["CQ22 columns"] and out["status"] == "fail"
