"""Overlapping and gapped time intervals per entity (problem 4), and dates written in several ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WRITTEN, PLAIN = "０１２３４５６７８９年月/.日", "0123456789----"  # the day sign goes away
PARTIAL_DATE = r"^(?!0000)\d{4}(-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?)?)?$"


def partial_date(text: Column, end: bool) -> Column:
    """The date that a text denotes, or null: year, month or day in digits of either width, parted by - / . or 年月日,
    with or without a time of day. A year or month alone means its first day, or with end its last. Impossible
    months and days, and any other text, give null."""
    s = F.rtrim(F.translate(F.trim(text, F.lit(" \t\u00a0\u3000")), WRITTEN, PLAIN), F.lit("-"))
    first = F.when(s.rlike(PARTIAL_DATE), s).try_cast("date")
    if not end:
        return first
    return F.when(F.length(s) == 4, F.last_day(F.add_months(first, 11))).when(F.length(s) <= 7, F.last_day(first)).otherwise(first)


def merge_intervals(df: DataFrame, key: str, start: str, end: str, shard_days: int = 4096) -> DataFrame:
    """Continuous periods and the gaps between them: key, kind ('period' or 'gap'), start, end (dates, both included).

    Two levels, so that no entity is merged in one task: intervals are clipped to time shards and merged within (key,
    shard), where a hot key has at most shard_days different starts, as equal starts are reduced to their longest
    before the shuffle. Only the first and last period of each shard go on to the key's own window, which joins those
    that meet at a shard's edge and finds the gaps that span shards.
    Intervals that share a day or follow on the next day are one period. Rows with a null key, start or end, or a
    start after the end, don't count. Repeated and nested rows add nothing; an empty input gives no rows.
    """
    s, e, w = F.col("s"), F.col("e"), F.lit(shard_days)
    longest = (
        df.filter(F.col(key).isNotNull() & (F.col(start) <= F.col(end)))
        .select(F.col(key).alias("k"), F.unix_date(start).alias("s"), F.unix_date(end).alias("e"))
        .groupBy("k", "s")
        .agg(F.max("e").alias("e"))
    )
    shard = F.col("shard")
    clipped = longest.select(
        "k", F.explode(F.sequence(F.floor(s / w).cast("int"), F.floor(e / w).cast("int"))).alias("shard"), "s", "e"
    ).select("k", "shard", F.greatest(s, shard * w).alias("s"), F.least(e, shard * w + (shard_days - 1)).alias("e"))
    in_shard = W.partitionBy("k", "shard")
    by_start = in_shard.orderBy("s")
    reach = F.max("e").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    local = (
        clipped.withColumn("new", F.when(reach.isNull() | (s > reach + 1), 1).otherwise(0))
        .withColumn("grp", F.sum("new").over(by_start))
        .groupBy("k", "shard", "grp")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .withColumn("then", F.lead("s").over(by_start))
        .withColumn("before", F.lag("e").over(by_start))
    )
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    pieces = lambda *p: F.explode(F.array_compact(F.array(*p))).alias("x")
    then, before = F.col("then"), F.col("before")
    inner = local.filter(then.isNotNull()).select(
        "k", pieces(F.when(before.isNotNull(), piece("period", s, e)), piece("gap", e + 1, then - 1))
    )
    by_key = W.partitionBy("k").orderBy("s")
    starts = F.when(F.col("new") == 1, F.struct("pe", "pshard", "shard"))
    edges = (
        local.filter(then.isNull() | before.isNull())
        .select("k", "shard", "s", "e", F.lag("e").over(by_key).alias("pe"), F.lag("shard").over(by_key).alias("pshard"))
        .withColumn("new", F.when(F.col("pe").isNull() | (s > F.col("pe") + 1), 1).otherwise(0))
        .withColumn("grp", F.sum("new").over(by_key))
        .groupBy("k", "grp")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(starts).alias("at"))
    )
    spans_shards = F.col("at.pshard") != F.col("at.shard")
    outer = edges.select("k", pieces(piece("period", s, e), F.when(spans_shards, piece("gap", F.col("at.pe") + 1, s - 1))))
    return inner.unionByName(outer).select(
        F.col("k").alias(key), "x.kind", F.date_from_unix_date("x.a").alias("start"), F.date_from_unix_date("x.b").alias("end")
    )
