"""Parent-child links of unknown depth to full hierarchies, with cycles (problem 2).

Ways up double in length each round, so a hierarchy of depth d takes some log2(d) joins and as many jobs, whatever its
depth; a join a level would leave the driver with plans and task records for every level. Only nodes that have children of
their own take part; leaves and roots are added by one join at the end. Nodes whose way up never ends hang on a cycle; they
are told apart first, by steps without paths, so that no path goes round a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, kept

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def code_key(code: Column) -> Column:
    """A code without regard to width, case, separators and spaces: ' Part-Of', 'partOf' and 'ｐａｒｔ＿ｏｆ' all give 'partof'."""
    return F.regexp_replace(F.lower(F.translate(code, FULL_WIDTH, HALF_WIDTH)), r"[^\p{L}\p{N}]", "")


def parent_links(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, parent) of rows with both ends; a node with several parents keeps the smallest (see other_parents)."""
    return (
        df.filter(F.col(child).isNotNull() & F.col(parent).isNotNull())
        .groupBy(F.col(child).alias("node"))
        .agg(F.min(parent).alias("parent"))
    )


def other_parents(df: DataFrame, child: str, parent: str) -> DataFrame:
    """The links that parent_links leaves out: distinct (node, parent) beyond a node's smallest parent."""
    both = df.filter(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(
        F.col(child).alias("node"), F.col(parent).alias("parent")
    )
    return both.distinct().join(parent_links(df, child, parent), ["node", "parent"], "left_anti")


def _rings(inner: DataFrame) -> DataFrame | None:
    """(node, parent, root) of the nodes on cycles, root being the cycle's smallest id; None where there is no cycle.

    Each round doubles the steps of all nodes at once; a node whose way up ends on the steps drops out. When neither the
    nodes left nor the places that they have come to grow fewer, the ways left are endless and those places are the cycles.
    """
    jump, last, before = inner.select("node", F.col("parent").alias("to")), None, None
    while True:
        far = jump.select(F.col("node").alias("to"), F.col("to").alias("then"))
        jump = last = kept(jump.join(far, "to").select("node", F.col("then").alias("to")), last)
        now = jump.agg(F.count("*"), F.count_distinct("to")).first()
        if not now[0]:
            return None
        if now == before:
            break
        before = now
    on, lower = jump.select(F.col("to").alias("node")).distinct(), True
    ring = cut(on.join(inner, "node").select("node", "parent", F.col("parent").alias("to"), F.least("node", "parent").alias("root")))
    while lower:  # stretches of equal length make up a cycle, so when none tells the one before it a smaller id, all know it
        far = ring.select(F.col("node").alias("to"), F.col("to").alias("then"), F.col("root").alias("far_root"))
        ring = cut(
            ring.join(far, "to").select(
                "node", "parent", F.col("then").alias("to"), F.least("root", "far_root").alias("root"), (F.col("far_root") < F.col("root")).alias("lower")
            )
        )
        lower = not ring.filter("lower").isEmpty()
    return ring.select("node", "parent", "root")


def _ways(free: DataFrame) -> DataFrame:
    """(node, parent, to, ids) of links without cycles: to is the first node above that is none of theirs, ids the way from
    below it down to the node. Ways double in length each round, and one that has come to its end isn't written again."""
    known = free.select(F.col("node").alias("to"), F.lit(True).alias("open"))
    step = free.select("node", "parent", F.col("parent").alias("to"), F.array("node").alias("ids")).join(known, "to", "left")
    step = kept(step.select("node", "parent", "to", "ids", F.coalesce("open", F.lit(False)).alias("open")))
    ended = [step.filter("not open")]
    while not step.filter("open").isEmpty():
        far = _union([*ended, step.filter("open")]).select(
            F.col("node").alias("to"), F.col("to").alias("then"), F.col("ids").alias("upper"), F.col("open").alias("still")
        )
        step = kept(
            step.filter("open").join(far, "to").select("node", "parent", F.col("then").alias("to"), F.concat("upper", "ids").alias("ids"), F.col("still").alias("open"))
        )
        ended.append(step.filter("not open"))
    return _union(ended).drop("open")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hierarchy(df: DataFrame, child: str, parent: str, sep: str = ">") -> DataFrame:
    """One row per node named by a link: node, parent, root, depth (long), path (text joined by sep), ids (the same
    as an array), cycle_state.

    cycle_state 'none': root is the node without a parent, depth the steps to it, path from it down.
    'on': the node lies on a cycle (a node that is its own parent included); root is the cycle's smallest id, depth 0,
    path the id itself. 'below': the way up ends in a cycle; root as before, depth and path from the first node on it.
    Links with a null end name no node; repeated links count once; of several parents the smallest counts
    (other_parents lists the rest); an empty input gives no rows; other columns are ignored.
    """
    links = parent_links(df, child, parent)
    tops = links.select(F.col("parent").alias("node")).distinct()
    nodes = kept(links.join(tops.withColumn("top", F.lit(True)), "node", "full_outer"))
    inner = nodes.filter("top and parent is not null").select("node", "parent")
    rings = _rings(inner)
    ways = _ways(inner if rings is None else inner.join(rings.select("node"), "node", "left_anti"))
    own, none = F.array("node"), F.lit("none")
    upper = nodes.filter("parent is null").select("node", "parent", F.col("node").alias("root"), own.alias("ids"), none.alias("cycle_state"))
    down = F.concat(F.array("to"), "ids").alias("ids")
    if rings is None:
        upper = upper.unionByName(ways.select("node", "parent", F.col("to").alias("root"), down, none.alias("cycle_state")))
    else:
        upper = upper.unionByName(rings.select("node", "parent", "root", own.alias("ids"), F.lit("on").alias("cycle_state")))
        ring = rings.select(F.col("node").alias("to"), F.col("root").alias("ring"))
        state = F.when(F.col("ring").isNotNull(), "below").otherwise("none")
        upper = upper.unionByName(
            ways.join(ring, "to", "left").select("node", "parent", F.coalesce("ring", "to").alias("root"), down, state.alias("cycle_state"))
        )
    above = upper.select(F.col("node").alias("parent"), "root", "ids", F.when(F.col("cycle_state") == "on", "below").otherwise(F.col("cycle_state")).alias("cycle_state"))
    leaves = nodes.filter("top is null").select("node", "parent").join(above, "parent")
    out = upper.unionByName(leaves.withColumn("ids", F.array_append("ids", F.col("node"))))
    return out.select("node", "parent", "root", (F.size("ids") - 1).cast("long").alias("depth"), F.array_join("ids", sep).alias("path"), "ids", "cycle_state")


def descendant_pairs(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every node of hierarchy() and each node above it, from the ids of its way down.

    No join is needed, and ids may hold any sign. Nodes on one cycle, each above the other, give no pairs among each
    other; nodes below a cycle pair with what lies above them from the cycle's first node on.
    """
    return (
        nodes.filter(F.col("depth") > 0)
        .select(F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("ids", 1, F.col("depth").cast("int"))))
        .select(F.col("col").alias("ancestor"), "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    )
