"""Values computed by hand or published with the statistics."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, stats


def runs(spark, scores, correct):
    return spark.createDataFrame(list(zip(scores, correct, strict=True)), "score double, correct int")


@pytest.mark.parametrize("correct, aurc, augrc", [([1, 1, 1, 0], 0.03125, 0.03125), ([0, 1, 1, 1], 47 / 96, 0.21875)])
def test_areas(spark, correct, aurc, augrc):
    curve = stats.risk_coverage(runs(spark, [0.9, 0.8, 0.7, 0.6], correct))
    assert [r.coverage for r in curve.orderBy("coverage").collect()] == [0, 0.25, 0.5, 0.75, 1]
    r = stats.areas(curve).first()
    assert r.aurc == pytest.approx(aurc) and r.augrc == pytest.approx(augrc)


def test_ties_are_one_point(spark):
    curve = stats.risk_coverage(runs(spark, [0.5, 0.5], [1, 0]))
    assert curve.count() == 2 and stats.areas(curve).first().aurc == 0.25


def test_selective_summary(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 0)], "accepted int, correct int")
    r = stats.selective_summary(df).first()
    assert (r.coverage, r.selective_risk, r.general_risk, r.safe_coverage, r.error_exposure) == pytest.approx((0.75, 1 / 3, 0.25, 0.5, 0.5))
    none = stats.selective_summary(df.filter("accepted = 0")).first()
    assert none.selective_risk is None and none.coverage == 0


def test_macro_f1(spark):
    df = spark.createDataFrame([("P", "P"), ("P", None), ("E", "E"), ("E", "O")], "y_true string, y_pred string")
    assert stats.macro_f1(df).first()[0] == pytest.approx(2 / 3) and stats.macro_f1(df, True).first()[0] == pytest.approx(5 / 6)


def test_wilson(spark):
    df = spark.createDataFrame([(25, 100), (0, 10), (10, 10), (0, 0)], "k int, n int")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got[0] == pytest.approx((0.17545211362, 0.34304463548)) and got[1] == pytest.approx((0, 0.27753279986)) and got[2] == pytest.approx((0.72246720014, 1)) and got[3] == (None, None)


def test_exact_tails():
    assert stats.binomial_two_sided(25, 5) == pytest.approx(0.0003249142318964005) and stats.binomial_two_sided(0, 0) == 1
    low, high = stats.clopper_pearson(0, 10)
    assert low == 0 and high == pytest.approx(1 - 0.025**0.1)
    assert stats.clopper_pearson(5, 10) == pytest.approx((0.187086, 0.812914), abs=1e-5)


def test_agreement(spark):
    fleiss = [("1", "A", 3), ("2", "B", 3), ("3", "A", 2), ("3", "B", 1), ("4", "A", 1), ("4", "B", 2)]
    assert stats.fleiss_kappa(spark.createDataFrame(fleiss, "item string, label string, n long")).first()[0] == pytest.approx(1 / 3)
    alpha = [("1", "0", 2), ("2", "0", 2), ("3", "1", 2), ("4", "0", 1), ("4", "1", 1)]
    assert stats.krippendorff_alpha(spark.createDataFrame(alpha, "item string, label string, n long")).first()[0] == pytest.approx(8 / 15)
    cohen = [("0", "0", 1), ("0", "1", 1), ("1", "1", 2)]
    assert stats.cohen_kappa(spark.createDataFrame(cohen, "a string, b string, n long")).first()[0] == pytest.approx(0.5)


def test_consensus_tiers(spark):
    cases = {"s": "XXX", "w": "XXY", "u": "XYZ", "n": "XX-", "S5": "XXXXY", "W5": "XXXYY", "U5": "XXYYZ"}
    rows = [(k, str(i), None if x == "-" else x) for k, v in cases.items() for i, x in enumerate(v)]
    got = {r["item"]: (r["label"], r["tier"]) for r in stats.vote_consensus(spark.createDataFrame(rows, "item string, rater string, label string")).collect()}
    assert got == {"s": ("X", "strong"), "w": ("X", "weak"), "u": (None, "unresolved"), "n": ("X", "weak"), "S5": ("X", "strong"), "W5": ("X", "weak"), "U5": (None, "unresolved")}


def test_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "d"), ("c", "d"), (None, "a"), ("q", "q")], "src string, dst string")
    assert [r["id"] for r in graph.shortest_path(e, "a", "d").orderBy("hop").collect()] == ["a", "x", "d"]
    assert graph.shortest_path(e, "a", "q").count() == 0 and graph.shortest_path(e, "a", "a").count() == 1
    assert graph.induced(e, spark.createDataFrame([("a",), ("b",)], "id string")).count() == 1 and graph.neighbours(e, "b").count() == 2
