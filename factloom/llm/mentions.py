"""Mentions: the entities that a pass over a page names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mentions(pages: DataFrame, repeated: bool = False) -> DataFrame:
    """mention, page_id, vote, name, type: one row per entry of parsed.entities with a name; repeated rows count once,
    or, with repeated, as often as they stand, for whoever makes rows distinct later."""
    entry = pages.filter(F.col("parsed").isNotNull()).select("page_id", "vote", F.posexplode("parsed.entities").alias("pos", "e"))
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    key = F.concat(F.lit("P"), pad("page_id", 9), F.lit("/"), F.col("vote").cast("string"), F.lit("/"), pad("pos", 3))
    named = entry.select(key.alias("mention"), "page_id", "vote", F.col("e.name").alias("name"), F.col("e.type").alias("type")).filter("name is not null")
    return named if repeated else named.distinct()
