"""Graph operators over edge frames (src, dst): neighbourhoods, induced subgraphs, shortest paths (section 2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """G-INDUCED: edges with both ends among ids(id); dangling edges go (G-MERGE)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """G-ENTITY, H-NEIGHBORS: edges of one node with their direction; a loop stands in both."""
    out = edges.filter(F.col("src") == node).withColumns({"direction": F.lit("out"), "neighbour": F.col("dst")})
    return out.unionByName(edges.filter(F.col("dst") == node).withColumns({"direction": F.lit("in"), "neighbour": F.col("src")}))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """H-PATH: (hop, id) along one shortest undirected path, or no rows; of equal parents the smallest counts.

    max_hops None sets no limit. Breadth-first by frontier joins; each node is kept once with its parent, and visited nodes are joined out.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).dropna()
    both = cut(both.union(both.select("b", "a")).distinct())
    spark = edges.sparkSession
    seen = spark.createDataFrame([(source, None, 0)], "id string, parent string, hop int")
    frontier, hop = seen, 0
    while source != target and (max_hops is None or hop < max_hops):
        hop += 1
        step = frontier.select(F.col("id").alias("a")).join(both, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            return seen.select("hop", "id").limit(0)
        seen = seen.unionByName(frontier)
        if not frontier.filter(F.col("id") == target).isEmpty():
            break
    path, at = [], target
    while at is not None:  # one lookup of one row a hop
        row = seen.filter(F.col("id") == at).select("hop", "id", "parent").first()
        if row is None:
            return seen.select("hop", "id").limit(0)
        path.append((row["hop"], row["id"]))
        at = row["parent"]
    return spark.createDataFrame(sorted(path), "hop int, id string")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) of every vertex of a link; the component is its smallest vertex.

    Large and small stars in turn: each vertex hangs its greater neighbours, then its smaller ones, below the least of
    its neighbourhood, until nothing changes. Null ends are no links, self links only name their vertex.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    vertices = ends.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    e = cut(ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
    return vertices.join(e.select(F.col("a").alias("vertex"), F.col("b").alias("component")), "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
