"""Exact places and running sums inside groups of any size, without a window over a whole group.

Rows are laid out by range of group and order, so that a hot group lies in many partitions. Each partition numbers and sums
its own stretch of a group; the stretches' totals, one row per partition and group, give what lies before each of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import cut, shuffle_width


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column] | None = None, totals: bool = False, peaks: Mapping[str, Column] | None = None) -> DataFrame:
    """df with __place (from 1 on, by order inside by), for each of sums its running sum up to and with the row, and for
    each of peaks the greatest value before the row (null for a group's first).

    order must tell all rows of a group apart, or the places of equal rows are given in any order. totals adds __n, the
    group's number of rows. Null groups are one group, null values count as nothing, an empty table gives no rows.
    """
    values, tops = dict(sums or {}), dict(peaks or {})
    laid = df.withColumns({f"__v_{k}": v for k, v in {**values, **tops}.items()}) if values or tops else df
    laid = laid.repartitionByRange(shuffle_width(df.sparkSession), *by, *order).sortWithinPartitions(*by, *order)
    marked = cut(laid.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    here = W.partitionBy("__part", *by).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    own = marked.withColumns({"__place": F.row_number().over(here), **{k: F.coalesce(F.sum(f"__v_{k}").over(here), F.lit(0)) for k in values}})
    if tops:
        earlier = W.partitionBy("__part", *by).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
        own = own.withColumns({k: F.max(f"__v_{k}").over(earlier) for k in tops})
    stretch = marked.groupBy("__part", *by).agg(F.count("*").alias("__n_here"), *(F.sum(f"__v_{k}").alias(f"__t_{k}") for k in values), *(F.max(f"__v_{k}").alias(f"__t_{k}") for k in tops))
    group = W.partitionBy(*by)
    before = group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0))
    ahead = stretch.select(
        F.col("__part").alias("__p"), *(F.col(b).alias(f"__b_{b}") for b in by), zero(F.sum("__n_here").over(before)).alias("__ahead"), F.sum("__n_here").over(group).alias("__n"),
        *(zero(F.sum(f"__t_{k}").over(before)).alias(f"__a_{k}") for k in values), *(F.max(f"__t_{k}").over(before).alias(f"__a_{k}") for k in tops),
    )
    same = F.col("__part") == F.col("__p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    out = own.join(ahead, same)
    return out.select(
        *df.columns, (F.col("__place") + F.col("__ahead")).alias("__place"), *((F.col(k) + F.col(f"__a_{k}")).alias(k) for k in values), *(F.greatest(k, f"__a_{k}").alias(k) for k in tops), *(["__n"] if totals else [])
    )
