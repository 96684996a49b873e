"""Pairs of rows that share a key, with a hot key's pairs spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import shuffle_width

PAIR_ROWS = 500  # a key of n rows has about n / PAIR_ROWS cells


def dealt(members: DataFrame, keys: Sequence[str], pair_rows: int, spread: str) -> tuple[DataFrame, DataFrame]:
    """Left and right ends with __cell: a key's cells form a square, and a left row goes to one line of it, a right row to one
    column, so each pair meets in one cell and a row is sent as often as the square root of the cells."""
    rows = members.dropna(subset=list(keys))
    cells = F.ceil(F.count("*") / pair_rows)
    sized = rows.join(rows.groupBy(*keys).agg(F.ceil(F.sqrt(cells)).alias("__lines"), F.ceil(cells / F.ceil(F.sqrt(cells))).alias("__columns")), list(keys))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda n: F.pmod(F.hash(spread), F.col(n))
    end = lambda df, p: df.select(*keys, "__cell", *(F.col(x).alias(f"{p}_{x}") for x in members.columns if x not in keys))
    left = sized.withColumn("__at", upto("__columns")).withColumn("__cell", one("__lines") * F.col("__columns") + F.col("__at"))
    right = sized.withColumn("__at", upto("__lines")).withColumn("__cell", F.col("__at") * F.col("__columns") + one("__columns"))
    return end(left, "a"), end(right, "b")


def pairs_within(members: DataFrame, keys: Sequence[str], meets: Column, pair_rows: int = PAIR_ROWS, spread: str = "id") -> DataFrame:
    """All pairs of members of one key that meet, a row with itself included: the keys, and the other columns of both ends
    prefixed a_ and b_.

    A key's rows are dealt out, by hash of spread, over about one cell for pair_rows of them (see dealt); keys are counted by an
    aggregate that combines before the shuffle, so no task holds all rows or all pairs of a key. Null keys pair nothing.
    """
    n = shuffle_width(members.sparkSession)
    left, right = (x.repartition(n, *keys, "__cell") for x in dealt(members, keys, pair_rows, spread))
    return left.join(right, [*keys, "__cell"]).filter(meets).drop("__cell")
