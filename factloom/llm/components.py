"""Pairwise matches to groups by seed-tree pruning (problem 5).

Each round, every vertex points its neighbourhood at that neighbourhood's minimum. A vertex that is not the minimum of
what points at it drops out and hangs below that minimum in the propagation forest; the minima go on, linked among each
other. The rounds end when no vertex is left, about logarithmically many in the vertices; then the seeds' identifiers
flow down the forest, whose depth is at most the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex of a link; root is the smallest vertex linked directly or indirectly.

    A hub's links are aggregated to its minimum before the shuffle; the join back to a hub's own links is an equi-join
    that adaptive execution splits. Links with a null end are no links; self links and repeated links add nothing but
    their vertex; an empty input gives no rows.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    both = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    vertices = both.select(F.col("u").alias("vertex")).distinct()
    graph = both.filter("u <> v")
    drops: list[DataFrame] = []
    while not graph.isEmpty():
        least = graph.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        told = cut(graph.join(least, "u").select(F.col("v").alias("u"), "m").unionByName(least).distinct())
        own = cut(told.groupBy("u").agg(F.min("m").alias("parent"), F.count("*").alias("n"), F.max(F.col("m") == F.col("u")).alias("seed")))
        links_up = told.join(own.filter("n > 1").select("u", "parent"), "u").filter("m <> parent").select(F.col("m").alias("u"), F.col("parent").alias("v"))
        drops.append(own.filter(~F.col("seed")).select(F.col("u").alias("vertex"), "parent"))
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        graph = cut(links_up.select(F.inline(ends)).distinct())  # read by the next round's count, minimum and join
    if not drops:
        return vertices.select("vertex", F.col("vertex").alias("root"))
    # the last to drop hang on seeds; going back, each earlier level hangs on vertices that have their root by then
    rooted = drops[-1].select("vertex", F.col("parent").alias("root"))
    for level in reversed(drops[:-1]):
        known = rooted.select(F.col("vertex").alias("parent"), "root")
        rooted = cut(rooted.unionByName(level.join(known, "parent", "left").select("vertex", F.coalesce("root", "parent").alias("root"))))
    return vertices.join(rooted, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))


def record_groups(links: DataFrame) -> DataFrame:
    """(space, record_id, group_id) of records that share their group with another record.

    links has space, record_id and via: each record of a space is linked with its via, which may be another record of
    the space, or an id that is none and only ties records together. Records sort before such ids, so the smallest of
    a group is a record. A row with a null via names its record only; a null record_id is no record.
    """
    rows = links.filter(F.col("record_id").isNotNull()).select("space", "record_id", "via")
    records = rows.select("space", "record_id").distinct()
    is_record = records.select("space", F.col("record_id").alias("via"), F.lit("0").alias("mark"))
    vertex = lambda mark, col: F.concat(mark, F.col("space"), F.lit("\x1f"), F.col(col))
    tied = rows.filter(F.col("via").isNotNull()).distinct().join(is_record, ["space", "via"], "left")
    roots = connected_components(
        tied.select(vertex(F.lit("0"), "record_id").alias("a"), vertex(F.coalesce("mark", F.lit("1")), "via").alias("b"))
    ).filter(F.col("vertex").startswith("0"))
    part = lambda col: F.substring_index(F.col(col), "\x1f", -1)
    others = cut(roots.filter("vertex <> root"))
    out = lambda df, of: df.select(
        F.expr(f"substr(substring_index({of}, '\x1f', 1), 2)").alias("space"), part(of).alias("record_id"), part("root").alias("group_id")
    )
    return out(others, "vertex").unionByName(out(others.select("root").distinct(), "root"))
