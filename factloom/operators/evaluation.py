"""Evaluation procedures that end on a handful of rows: calibration bins, fronts, post-stratification, matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.ranks import running


def equal_count_bins(rows: DataFrame, bins: int, score: str, key: str) -> DataFrame:
    """(bin, n, score, correct): bins of equal counts by rising score. Scores are ranked by quantile bounds of the
    distinct scores' running counts, so that no window runs over all rows; equal scores share a bin."""
    at = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    at = running(at, [], [F.col("s")], {"upto": F.col("n")})
    total = at.agg(F.sum("n")).first()[0] or 1
    b = F.least(F.floor((F.col("upto") - F.col("n")) * bins / F.lit(total)), F.lit(bins - 1)).cast("int")
    return at.withColumn("bin", b).groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("score"), (F.sum("k") / F.sum("n")).alias("correct"))


def single_pass_isotonic(bins: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """M-ISOTONIC: one forward pass over (score, accuracy) bins; a bin below its predecessor is merged with it by the
    plain mean, once, without going back (not the full pooling of adjacent violators)."""
    out: list[tuple[float, float]] = []
    for x, y in bins:
        if out and y < out[-1][1]:
            px, py = out.pop()
            out.append(((px + x) / 2, (py + y) / 2))
        else:
            out.append((x, y))
    return out


def knee(points: Sequence[tuple[float, float]]) -> tuple[float, float] | None:
    """M-PARETO-KNEE: of the points that none beats in both (small cost, large gain), the one farthest above the chord."""
    front: list[tuple[float, float]] = []
    for cost, gain in sorted(points, key=lambda p: (p[0], -p[1])):
        if not front or gain > front[-1][1]:
            front.append((cost, gain))
    if not front:
        return None
    (x0, y0), (x1, y1) = front[0], front[-1]
    above = lambda p: (p[1] - y0) - (y1 - y0) * ((p[0] - x0) / (x1 - x0) if x1 > x0 else 0)
    return max(front, key=lambda p: (above(p), -p[0]))


def pareto_knee(points: DataFrame, cost: str, gain: str) -> DataFrame:
    """The same for any number of points: the front by the greatest gain at lower cost, its two ends as one row, then the
    point farthest above their chord; of equal ones the cheapest. Null points don't count; no points give no row."""
    at = running(points.select(cost, gain).dropna().distinct(), [], [F.col(cost), F.col(gain).desc()], peaks={"__peak": F.col(gain)})
    front = at.filter(F.col("__peak").isNull() | (F.col(gain) > F.col("__peak"))).select(cost, gain)
    ends = front.agg(F.min(cost).alias("x0"), F.max(cost).alias("x1"), F.min_by(gain, cost).alias("y0"), F.max_by(gain, cost).alias("y1"))
    way = F.when(F.col("x1") > F.col("x0"), (F.col(cost) - F.col("x0")) / F.when(F.col("x1") > F.col("x0"), F.col("x1") - F.col("x0"))).otherwise(0.0)
    above = F.round(F.col(gain) - F.col("y0") - (F.col("y1") - F.col("y0")) * way, 12)
    return front.join(F.broadcast(ends)).orderBy(above.desc(), cost).limit(1).select(cost, gain)


def poststratified(sample: DataFrame, sizes: DataFrame, stratum: str, value: str) -> DataFrame:
    """M-POSTSTRAT: the mean of value over the population, strata weighted by sizes(stratum, size). Strata without a
    sampled row are left out of weight and sum, and counted."""
    means = sample.groupBy(stratum).agg(F.avg(value).alias("m"))
    j = sizes.join(means, stratum, "left")
    known = F.col("m").isNotNull()
    w = F.sum(F.when(known, F.col("size")))
    return j.agg((F.sum(F.when(known, F.col("m") * F.col("size"))) / w).alias("estimate"), w.alias("covered"), F.sum((~known).cast("int")).alias("empty_strata"))


def matched_controls(cases: DataFrame, controls: DataFrame, levels: Sequence[Sequence[str]], key: str = "id") -> DataFrame:
    """(case, control, level): exact matches on ever fewer columns, without replacement. Within a cell, the n-th
    case by id hash gets the n-th control; what is left goes to the next level."""
    from factloom.session import cut

    left, right, out = cases, controls, None
    for i, columns in enumerate(levels):
        rank = F.row_number().over(W.partitionBy(*columns).orderBy(F.xxhash64(key), key))
        a = left.select(F.col(key).alias("case"), *columns, rank.alias("rn"))
        b = right.select(F.col(key).alias("control"), *columns, rank.alias("rn"))
        pairs = cut(a.join(b, [*columns, "rn"]).select("case", "control", F.lit(i).alias("level")))
        out = pairs if out is None else out.unionByName(pairs)
        left = left.join(pairs.select(F.col("case").alias(key)), key, "left_anti")
        right = right.join(pairs.select(F.col("control").alias(key)), key, "left_anti")
    return out


def frequent_rules(rows: DataFrame, atoms: Sequence[str], target: str, support: int, width: int = 3) -> DataFrame:
    """All conjunctions of up to width atoms (boolean columns) with enough support: rule, support, hits, share.

    Each row gives the combinations of its true atoms, with the usual pruning: a longer rule is only built from atoms
    that are frequent alone. Their number is bounded by the atoms, whatever the number of rows, and sums combine before
    the shuffle.
    """
    alone = rows.agg(*[F.sum(F.col(a).cast("int")).alias(a) for a in atoms]).first()
    kept = [a for a in atoms if (alone[a] or 0) >= support]
    if not kept:
        return rows.select(F.lit("").alias("rule"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("hits"), F.lit(0.0).alias("share")).limit(0)
    pattern = rows.groupBy(*kept).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("int")).alias("k"))  # at most 2^atoms rows
    true = F.array_compact(F.array(*[F.when(F.col(a), F.lit(a)) for a in kept]))
    combos = F.transform(true, lambda x: F.array(x))
    every = combos
    for _ in range(width - 1):
        combos = F.flatten(F.transform(combos, lambda c: F.transform(F.filter(true, lambda x: x > F.element_at(c, -1)), lambda x: F.concat(c, F.array(x)))))
        every = F.concat(every, combos)
    g = pattern.select(F.explode(F.transform(every, lambda c: F.concat_ws("&", c))).alias("rule"), "n", "k").groupBy("rule").agg(F.sum("n").alias("support"), F.sum("k").alias("hits"))
    return g.filter(F.col("support") >= support).withColumn("share", F.col("hits") / F.col("support"))


def bootstrap(counts: DataFrame, statistic: Callable[[np.ndarray, np.ndarray], np.ndarray], value: str, stratum: str | None = None, replicates: int = 2000, seed: int = 7) -> tuple[float, float] | None:
    """M-BOOTSTRAP: the 2.5 and 97.5 percentiles of a statistic over resampled rows, or None without rows.

    counts: value (a few different ones), n and, if stratified, the stratum: rows alike fall into one count, and drawing n
    of n rows anew is one multinomial draw over the counts, so neither rows nor replicates of them are ever formed. The
    counts come to the driver, one row per stratum and value. statistic: (replicates x values of draws, values) to one
    number per replicate; strata are drawn apart, each with its own size, and their draws added.
    """
    rows = counts.filter(F.col(value).isNotNull()).select(F.col(stratum) if stratum else F.lit(0).alias("stratum"), value, "n").collect()
    if not rows:
        return None
    values = sorted({r[1] for r in rows})
    rng, drawn = np.random.default_rng(seed), np.zeros((replicates, len(values)))
    for s in sorted({r[0] for r in rows}, key=str):
        n = np.zeros(len(values), np.int64)
        for r in rows:
            if r[0] == s:
                n[values.index(r[1])] += r[2]
        if n.sum():
            drawn += rng.multinomial(int(n.sum()), n / n.sum(), size=replicates)
    got = statistic(drawn, np.array(values, dtype=float))
    return float(np.percentile(got, 2.5)), float(np.percentile(got, 97.5))


def mean_of(drawn: np.ndarray, values: np.ndarray) -> np.ndarray:
    return drawn @ values / drawn.sum(axis=1)
