"""References to records that do not exist, are deleted or come later (problem 3)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Reference(NamedTuple):
    """A column of a referring table that should name a key of a target table."""

    table_name: str
    rows: DataFrame
    column: str
    target: str


class Target(NamedTuple):
    table_name: str
    rows: DataFrame
    key: str


def _tagged(role: str, target, key, by=None, month=None, first=None, last=None) -> list:
    none = F.lit(None)
    return [
        F.lit(role).alias("role"),
        target.alias("target"),
        key.alias("key"),
        (none if by is None else by).cast("string").alias("by"),
        (none if month is None else month).cast("string").alias("month"),
        (none if first is None else first).cast("timestamp_ntz").alias("first_at"),
        (none if last is None else last).cast("timestamp_ntz").alias("last_at"),
    ]


def orphan_references(
    references: Sequence[Reference], targets: Sequence[Target], tombstones: DataFrame, at: str = "ingested_at"
) -> DataFrame:
    """Distinct orphan references: table_name, ref_id, ref_month, reason ('deleted', 'missing' or 'late').

    Children, parents and tombstones are aggregated to their keys before the shuffle (a hot key becomes one row per
    month and task), then brought together in long form and grouped by target table and key. A month of a key's
    references needs only its first and last time: any row not before the deletion is 'deleted', any row before both
    the deletion and the record is 'late', and 'missing' if the target has no such key.
    tombstones has target_table, record_id, deleted_at. Null references are no case. A row without a time is never
    deleted or late; it is missing, in a null month, if its key is nowhere. Empty tables give no rows.
    """
    long = []
    for r in references:
        month = F.date_format(F.col(at), "yyyy-MM")
        long.append(
            r.rows.select(F.col(r.column).alias("key"), F.col(at).alias("at"))
            .filter(F.col("key").isNotNull())
            .groupBy("key", F.date_format("at", "yyyy-MM").alias("month"))
            .agg(F.min("at").alias("first"), F.max("at").alias("last"))
            .select(_tagged("child", F.lit(r.target), F.col("key"), F.lit(r.table_name), F.col("month"), F.col("first"), F.col("last")))
        )
    for t in targets:
        long.append(
            t.rows.select(F.col(t.key).alias("key"), F.col(at).alias("at"))
            .filter(F.col("key").isNotNull())
            .groupBy("key")
            .agg(F.min("at").alias("first"))
            .select(_tagged("parent", F.lit(t.table_name), F.col("key"), first=F.col("first")))
        )
    long.append(
        tombstones.filter(F.col("record_id").isNotNull())
        .groupBy("target_table", "record_id")
        .agg(F.min("deleted_at").alias("first"))
        .select(_tagged("tombstone", F.col("target_table"), F.col("record_id"), first=F.col("first")))
    )
    union = long[0]
    for x in long[1:]:
        union = union.unionByName(x)
    role = lambda name: F.col("role") == name
    keys = (
        union.groupBy("target", "key")
        .agg(
            F.max(role("parent")).alias("there"),
            F.min(F.when(role("parent"), F.col("first_at"))).alias("born"),
            F.min(F.when(role("tombstone"), F.col("first_at"))).alias("died"),
            F.collect_list(F.when(role("child"), F.struct("by", "month", "first_at", "last_at"))).alias("refs"),
        )
        .filter(F.size("refs") > 0)
        .select("key", "there", "born", "died", F.explode("refs").alias("r"))
    )
    first, last = F.col("r.first_at"), F.col("r.last_at")
    before_death = F.col("died").isNull() | first.isNull() | (first < F.col("died"))
    reasons = F.array_compact(
        F.array(
            F.when(last >= F.col("died"), F.lit("deleted")),
            F.when(before_death & ~F.col("there"), F.lit("missing")),
            F.when(before_death & F.col("there") & (first < F.col("born")), F.lit("late")),
        )
    )
    return keys.select(
        F.col("r.by").alias("table_name"), F.col("key").alias("ref_id"), F.col("r.month").alias("ref_month"), F.explode(reasons).alias("reason")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Distinct orphan references per table, month and reason."""
    return orphans.groupBy("table_name", "ref_month", "reason").agg(F.count("*").alias("n_references"))
