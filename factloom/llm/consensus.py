"""Consensus of several annotators' labels, with agreement per item and reliability per annotator (problem 7).

An annotator's reliability is the entry of the leading eigenvector of the annotators' agreement matrix. Votes are
centred by each annotator's own label shares, so that agreement by chance, and annotators who always say the same,
count nothing; every entry is corrected for the number of items that two annotators share. The matrix is never built:
each power step runs as sparse joins of the votes with the current vector, until the vector stands still. Votes weighted
so give the consensus. One number per annotator can't use who swaps two labels but is consistent; as a named option
(sharpen) each annotator's confusion of labels is counted against that consensus, and the votes are weighed by it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def clean_label(label: Column) -> Column:
    """A label in capitals with single underscores, whatever its case, spaces and separators."""
    return F.regexp_replace(F.regexp_replace(F.upper(label), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def clean_votes(votes: DataFrame, item: str, rater: str, label: str, labels: Sequence[str], at: str | None = None) -> DataFrame:
    """(item, rater, label): one valid vote of each rater on an item; of different ones the last (without at: the smallest).

    Labels outside labels, nulls among them, are void; items and raters must not be null.
    """
    rows = votes.select(
        F.col(item).alias("item"), F.col(rater).alias("rater"), clean_label(F.col(label)).alias("label"), (F.col(at) if at else F.lit(0)).alias("at")
    )
    valid = rows.filter(F.col("label").isin(*labels) & F.col("item").isNotNull() & F.col("rater").isNotNull())
    return valid.groupBy("item", "rater").agg(F.max_by("label", F.struct("at", "label")).alias("label"))


def _is(label: str) -> Column:
    return (F.col("label") == label).cast("double")


def spectral_reliability(votes: DataFrame, labels: Sequence[str], tolerance: float = 1e-3, most_rounds: int = 200) -> DataFrame:
    """(rater, n_votes, reliability): about 1 for a rater who is always right, 0 for chance or ever the same label,
    below 0 for worse.

    votes is the result of clean_votes. Each round, rater i gets the sum over the other raters j of reliability j times
    their centred agreement with i, divided by the sum of reliability j squared over the items that both voted on. The
    rounds end when no entry moves by more than tolerance times the greatest, and raise an error after most_rounds.
    """
    k = range(len(labels))
    shares = votes.groupBy("rater").agg(F.count("*").alias("n_votes"), *(F.avg(_is(x)).alias(f"q{i}") for i, x in zip(k, labels, strict=True)))
    shares = cut(shares)
    x = cut(votes.join(shares, "rater").select("item", "rater", *((_is(y) - F.col(f"q{i}")).alias(f"x{i}") for i, y in zip(k, labels, strict=True))))
    r = shares.select("rater", F.lit(1.0).alias("r"))
    for _ in range(most_rounds):
        weighted = x.join(r, "rater")
        of_item = weighted.groupBy("item").agg(F.sum(F.col("r") * F.col("r")).alias("qq"), *(F.sum(F.col("r") * F.col(f"x{i}")).alias(f"s{i}") for i in k))
        both = weighted.join(of_item, "item")
        agree = sum((F.col(f"x{i}") * (F.col(f"s{i}") - F.col("r") * F.col(f"x{i}")) for i in k), F.lit(0.0))
        step = both.groupBy("rater").agg(F.first("r").alias("old"), F.sum(agree).alias("u"), F.sum(F.col("qq") - F.col("r") * F.col("r")).alias("d"))
        moved = F.when(F.col("d") > 1e-12, F.col("u") / F.when(F.col("d") > 1e-12, F.col("d"))).otherwise(0.0)
        told = cut(step.select("rater", "old", moved.alias("new")))
        size = told.agg(F.sqrt(F.sum(F.col("old") * F.col("old"))).alias("old"), F.sqrt(F.sum(F.col("new") * F.col("new"))).alias("new")).first()
        # a vector that is too long by some factor comes back too short by the same, so the length between both is right
        scale = math.sqrt(size["old"] / size["new"]) if size["old"] and size["new"] else 1.0
        r = told.select("rater", (F.col("new") * scale).alias("r"))
        move = told.agg(F.max(F.abs(F.col("new") * scale - F.col("old"))).alias("by"), F.max(F.abs(F.col("new") * scale)).alias("of")).first()
        if (move["by"] or 0.0) <= tolerance * max(move["of"] or 0.0, 1e-6):
            break
    else:
        raise RuntimeError(f"the reliabilities still move after {most_rounds} rounds")
    total = r.agg(F.sum("r").alias("t")).first()["t"] or 0.0
    sign = 1.0 if total >= 0 else -1.0
    q2 = sum((F.col(f"q{i}") * F.col(f"q{i}") for i in k), F.lit(0.0))
    varies = 1 - q2 > 1e-6  # who always says the same tells nothing
    scaled = F.when(varies, sign * F.col("r") / F.sqrt(F.when(varies, 1 - q2))).otherwise(0.0)
    return shares.join(r, "rater").select("rater", "n_votes", F.round(F.greatest(F.least(scaled, F.lit(1.0)), F.lit(-1.0)), 9).alias("reliability"))


def _best(scores: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The label of the greatest score per item; of equal scores the first label."""
    top = F.greatest(*(F.col(f"s{i}") for i in range(len(labels)))) if len(labels) > 1 else F.col("s0")
    pick = F.coalesce(*(F.when(F.col(f"s{i}") >= top - 1e-9, F.lit(x)) for i, x in enumerate(labels)))
    return scores.select("item", pick.alias("consensus"))


def consensus(votes: DataFrame, labels: Sequence[str], sharpen: int = 0) -> tuple[DataFrame, DataFrame]:
    """((item, consensus), (rater, n_votes, reliability)) of the votes of clean_votes.

    With sharpen 0 the spectral weights alone decide. sharpen: how often the raters' confusions are counted against the
    consensus and the votes weighed by them.
    Counts are smoothed by the rater's reliability, so that a rater of few votes keeps about its spectral weight.
    """
    k, n = range(len(labels)), len(labels)
    reliability = cut(spectral_reliability(votes, labels))
    right = 1 / n + (1 - 1 / n) * F.greatest(F.least(F.col("reliability"), F.lit(0.97)), F.lit(0.0))
    table = reliability.select("rater", F.explode(F.array(*map(F.lit, labels))).alias("label"), right.alias("p"))
    weights = table.select("rater", "label", *(F.log(F.when(F.col("label") == x, F.col("p")).otherwise((1 - F.col("p")) / (n - 1))).alias(f"w{i}") for i, x in zip(k, labels, strict=True)))
    prior = [F.lit(0.0)] * n
    best = None
    for turn in range(sharpen + 1):
        scored = votes.join(weights, ["rater", "label"]).groupBy("item").agg(*(F.sum(f"w{i}").alias(f"s{i}") for i in k))
        best = cut(_best(scored.select("item", *((F.col(f"s{i}") + prior[i]).alias(f"s{i}") for i in k)), labels))
        if turn == sharpen:
            break
        truth = best.groupBy("consensus").agg(F.count("*").alias("n")).collect()  # one row per label
        total = sum(r["n"] for r in truth)
        of = {r["consensus"]: r["n"] for r in truth}
        prior = [F.log(F.lit((of.get(x, 0) + 1) / (total + n))) for x in labels]
        counted = votes.join(best, "item").groupBy("rater", "label").agg(*(F.sum((F.col("consensus") == x).cast("double")).alias(f"c{i}") for i, x in zip(k, labels, strict=True)))
        filled = table.join(counted, ["rater", "label"], "left").na.fill(0.0)
        prior_p = lambda x: F.when(F.col("label") == x, F.col("p")).otherwise((1 - F.col("p")) / (n - 1))
        sums = filled.groupBy("rater").agg(*(F.sum(f"c{i}").alias(f"t{i}") for i in k))
        weights = cut(
            filled.join(sums, "rater").select("rater", "label", *(F.log((F.col(f"c{i}") + 10 * prior_p(x)) / (F.col(f"t{i}") + 10)).alias(f"w{i}") for i, x in zip(k, labels, strict=True)))
        )
    return best, reliability


def item_agreement(votes: DataFrame, best: DataFrame) -> DataFrame:
    """(item, n_votes, consensus, consensus_share, pair_agreement): shares of votes and of vote pairs that agree.

    An item of best without votes has n_votes 0 and null shares; pair_agreement is null where there is one vote only. Pairs are counted from the labels' counts, never formed.
    """
    counts = votes.groupBy("item", "label").agg(F.count("*").alias("n"))
    item = best.join(counts, "item", "left").groupBy("item", "consensus").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_votes"), F.sum(F.when(F.col("label") == F.col("consensus"), F.col("n")).otherwise(0)).alias("hits"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")
    )
    pairs = F.col("n_votes") * (F.col("n_votes") - 1)
    return item.select(
        "item", "n_votes", "consensus", F.round(F.when(F.col("n_votes") > 0, F.col("hits") / F.when(F.col("n_votes") > 0, F.col("n_votes"))), 6).alias("consensus_share"),
        F.round(F.when(pairs > 0, F.col("same") / F.when(pairs > 0, pairs)), 6).alias("pair_agreement"),
    )


def named_by_most(passes: DataFrame, naming: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """(item, label, n_passes, n_naming): what more than half of an item's passes name, each pass counted once."""
    size = passes.select(item, rater).distinct().groupBy(item).agg(F.count("*").alias("n_passes"))
    said = naming.select(item, rater, label).distinct().groupBy(item, label).agg(F.count("*").alias("n_naming"))
    return said.join(size, item).filter(F.col("n_naming") * 2 > F.col("n_passes"))


def naming_votes(passes: DataFrame, naming: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """(item, label, rater, said): 'named' or 'not_named' of each pass for everything that some pass of its item names."""
    every = passes.select(item, rater).dropna().distinct()
    said = naming.select(item, rater, label).dropna().distinct()
    asked = said.select(item, label).distinct().join(every, item)
    votes = asked.join(said.withColumn("said", F.lit("named")), [item, rater, label], "left")
    return votes.select(F.col(item).alias("item"), F.col(label).alias("label"), F.col(rater).alias("rater"), F.coalesce("said", F.lit("not_named")).alias("said"))


def named_or_not(votes: DataFrame) -> DataFrame:
    """(item, consensus) of votes (item, rater, label) of named and not_named: named needs more than half."""
    named = F.sum(_is("named")) * 2 > F.count("*")
    return votes.groupBy("item").agg(F.when(named, "named").otherwise("not_named").alias("consensus"))
