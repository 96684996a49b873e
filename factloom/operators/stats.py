"""Evaluation statistics of selective prediction and rater agreement, closed form over aggregated counts (section 2.14)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _div(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """M-WILSON: lower and upper bound of a share; null for n = 0."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, w = k / n, 1 + z * z / n
    half = z / w * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    mid = (p + z * z / (2 * n)) / w
    some = n.isNotNull()  # greatest and least pass over nulls
    return F.when(some, F.greatest(mid - half, F.lit(0.0))), F.when(some, F.least(mid + half, F.lit(1.0)))


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """M-NEWCOMBE: bounds of the difference of two shares, from their Wilson bounds."""
    (l1, u1), (l2, u2), p1, p2 = wilson(k1, n1), wilson(k2, n2), _div(k1, n1), _div(k2, n2)
    d = p1 - p2
    return d - F.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), d + F.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)


def binomial_two_sided(b: int, c: int) -> float:
    """M-MCNEMAR exact: the two-sided tail of the smaller count under one half; 1 without discordant pairs."""
    n = b + c
    if n == 0:
        return 1.0
    log_half = -n * math.log(2)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + log_half) for i in range(min(b, c) + 1))
    return min(1.0, 2 * tail)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """M-CLOPPER-PEARSON: exact bounds by bisection of the binomial tails."""

    def tail(p: float, low: int, high: int) -> float:
        if p <= 0 or p >= 1:
            return float(low <= (0 if p <= 0 else n) <= high)
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(low, high + 1))

    def root(f) -> float:
        a, b = 0.0, 1.0
        for _ in range(80):
            m = (a + b) / 2
            a, b = (m, b) if f(m) else (a, m)
        return (a + b) / 2

    low = 0.0 if k == 0 else root(lambda p: tail(p, k, n) < alpha / 2)
    high = 1.0 if k == n else root(lambda p: tail(p, 0, k) > alpha / 2)
    return low, high


def risk_coverage(runs: DataFrame, by: list[str] = [], score: str = "score", correct: str = "correct") -> DataFrame:  # noqa: B006
    """M-RC-CURVE: one point per distinct score, ties accepted together, from the highest down; the origin comes first.

    Scores are first aggregated, so the running sums go over distinct scores only. Columns: by, score (null at the
    origin), coverage, risk (of the accepted; 0 at the origin), general_risk (errors over all rows).
    """
    at = runs.groupBy(*by, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(1 - F.col(correct).cast("int")).alias("e"))
    w = W.partitionBy(*by)
    run = w.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    points = at.withColumns({"cn": F.sum("n").over(run), "ce": F.sum("e").over(run), "total": F.sum("n").over(w)}).select(
        *by, "score", (F.col("cn") / F.col("total")).alias("coverage"), (F.col("ce") / F.col("cn")).alias("risk"), (F.col("ce") / F.col("total")).alias("general_risk")
    )
    zero = F.lit(0.0)
    origin = runs.groupBy(*by).agg(F.lit(None).cast(at.schema["score"].dataType).alias("score")).select(*by, "score", zero.alias("coverage"), zero.alias("risk"), zero.alias("general_risk"))
    return origin.unionByName(points)


def areas(curve: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """M-AURC, M-AUGRC: areas under the two risks over coverage by the trapezoid rule (W-TRAPEZOID)."""
    w = W.partitionBy(*by).orderBy("coverage")
    step = F.col("coverage") - F.lag("coverage").over(w)
    part = lambda y: step * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.withColumns({"a": part("risk"), "g": part("general_risk")}).groupBy(*by).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("aurc"), F.coalesce(F.sum("g"), F.lit(0.0)).alias("augrc"))


def selective_summary(runs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """M-COVERAGE, M-SEL-RISK, M-SEL-ACC, M-GEN-RISK, M-SAFE-COV, M-ERR-EXPOSURE over accepted and correct (0 or 1).

    Null where nothing is accepted (selective risk and accuracy) or nothing is wrong (exposure).
    """
    a, k = F.col("accepted").cast("int"), F.col("correct").cast("int")
    g = runs.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("acc"), F.sum(a * (1 - k)).alias("wrong"), F.sum(1 - k).alias("errors"))
    n, acc, wrong = F.col("n"), F.col("acc"), F.col("wrong")
    return g.select(
        *by, (acc / n).alias("coverage"), _div(wrong, acc).alias("selective_risk"), (1 - _div(wrong, acc)).alias("selective_accuracy"), (wrong / n).alias("general_risk"),
        ((acc - wrong) / n).alias("safe_coverage"), _div(wrong, F.col("errors")).alias("error_exposure"),
    )


def macro_f1(rows: DataFrame, accepted_only: bool = False) -> DataFrame:
    """M-MACRO-F1 of y_true and y_pred (null: abstained). Classes are those of y_true; abstentions miss, or are left out."""
    rows = rows.filter("y_pred is not null") if accepted_only else rows
    t = rows.groupBy(F.col("y_true").alias("y")).agg(F.count("*").alias("t"), F.sum((F.col("y_true") == F.coalesce("y_pred", F.lit("\x00"))).cast("int")).alias("tp"))
    p = rows.filter("y_pred is not null").groupBy(F.col("y_pred").alias("y")).agg(F.count("*").alias("p"))
    f1 = t.join(p, "y", "left").select((2 * F.col("tp") / (F.col("t") + F.coalesce("p", F.lit(0)))).alias("f1"))
    return f1.agg(F.avg("f1").alias("macro_f1"))


def auroc(rows: DataFrame, by: list[str] = [], score: str = "score", positive: str = "positive") -> DataFrame:  # noqa: B006
    """M-AUROC by the rank sum with average ranks of ties; null without both classes."""
    at = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("int")).alias("k"))
    below = F.sum("n").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    g = at.withColumn("r", F.col("k") * (below + (F.col("n") + 1) / 2)).groupBy(*by).agg(F.sum("r").alias("r"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    k, m = F.col("k"), F.col("n") - F.col("k")
    return g.select(*by, _div(F.col("r") - k * (k + 1) / 2, k * m).alias("auroc"))


def fleiss_kappa(counts: DataFrame) -> DataFrame:
    """M-FLEISS over (item, label, n) with equally many raters per item."""
    item = counts.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("s"))
    po = item.agg(F.avg(_div(F.col("s"), F.col("m") * (F.col("m") - 1))).alias("po"))
    share = counts.groupBy("label").agg(F.sum("n").alias("n")).withColumn("q", F.col("n") / F.sum("n").over(W.partitionBy()))
    pe = share.agg(F.sum(F.col("q") * F.col("q")).alias("pe"))
    return po.join(F.broadcast(pe)).select(_div(F.col("po") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def krippendorff_alpha(counts: DataFrame) -> DataFrame:
    """M-KRIPPENDORFF (nominal) over (item, label, n); items of one vote don't count."""
    m = F.sum("n").over(W.partitionBy("item"))
    pairable = counts.withColumn("m", m).filter("m > 1")
    within = pairable.agg(F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("do"), F.sum("n").alias("total"))
    label = pairable.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    t = F.col("total")
    return within.join(F.broadcast(label)).select((1 - _div(F.col("do") * (t - 1), t * t - F.col("sq"))).alias("alpha"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """M-COHEN over (a, b, n): counts of label pairs of two raters."""
    n = pairs.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    a, b = (pairs.groupBy(F.col(x).alias("y")).agg(F.sum("n").alias(f"n{x}")) for x in "ab")
    chance = a.join(b, "y").agg(F.sum(F.col("na") * F.col("nb")).alias("c"))
    po, pe = F.col("same") / F.col("t"), F.coalesce("c", F.lit(0)) / (F.col("t") * F.col("t"))
    return n.join(F.broadcast(chance)).select(_div(po - pe, 1 - pe).alias("kappa"))


def vote_consensus(votes: DataFrame) -> DataFrame:
    """M-CONSENSUS over (item, rater, label): label and tier by the top count of 3 or 5 raters.

    All valid votes of three, or four of five, equal: strong; two of three, or three of five: weak; else unresolved
    with a null label. A null label is no vote, but its rater counts as asked.
    """
    asked = votes.groupBy("item").agg(F.countDistinct("rater").alias("asked"))
    n = votes.filter("label is not null").groupBy("item", "label").agg(F.countDistinct("rater").alias("n"))
    top = n.groupBy("item").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("x"))
    k, five = -F.col("x.n"), F.col("asked") >= 5
    tier = F.when(k >= F.when(five, 4).otherwise(3), "strong").when(k >= F.when(five, 3).otherwise(2), "weak").otherwise("unresolved")
    out = asked.join(top, "item", "left").withColumn("tier", F.coalesce(tier, F.lit("unresolved")))
    return out.select("item", F.when(F.col("tier") != "unresolved", F.col("x.label")).alias("label"), "tier")


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """M-PREDICTOR-ML: ECE over equal-width bins of the score, and the Brier score."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = rows.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg(F.col("correct").cast("double")).alias("k"), F.sum((F.col("score") - F.col("correct")) ** 2).alias("q"))
    n = F.sum("n")
    return per.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("k"))) / n).alias("ece"), (F.sum("q") / n).alias("brier"))
