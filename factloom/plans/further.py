"""Joins, groupings, windows and set operations that the other modules leave out, thresholds, and components in the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators.graph import components
from factloom.operators.ranks import running
from factloom.plans import analytics, base
from factloom.plans.base import over
from factloom.session import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
c = F.col


def add(key: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[key] = f
        if sql:
            SQL[key] = over(sql)
        return f

    return keep


# 2.3 joins
@add("J-RIGHT", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def _(s, d):
    rich = table(s, d, "supplier").filter("s_acctbal > 5000").select("s_suppkey", c("s_nationkey").alias("n_nationkey"))
    return rich.join(table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "right").select("n_name", "s_suppkey")


@add("J-FULL", "SELECT coalesce(x.k, y.k) AS k, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) x FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) y ON x.k = y.k")
def _(s, d):
    x = table(s, d, "customer").groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    y = table(s, d, "supplier").groupBy(c("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return x.join(y, "k", "full")


@add("J-NATURAL", "SELECT event_id, fact_id, cell_id FROM (SELECT DISTINCT event_id, fact_id FROM links) NATURAL JOIN (SELECT DISTINCT fact_id, cell_id FROM cell_support)")
def _(s, d):
    a, b = base.links(s, d).select("event_id", "fact_id").distinct(), base.cell_support(s, d).select("fact_id", "cell_id").distinct()
    return a.join(b, [x for x in a.columns if x in b.columns])


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with value: that of right's latest row of the same by whose at isn't later; of equal times the greatest value.

    Both sides become one sequence per key. A key's stretch of time is cut by range, so that a hot key spreads over many
    partitions; a row without a value in its own stretch takes the last one of the stretches before. Null keys and times
    match nothing and keep a null value.
    """
    ok = c(by).isNotNull() & c(at).isNotNull()
    mine = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    theirs = right.filter(ok & c(value).isNotNull()).select(by, at, c(value).alias("__v"), F.lit(0).alias("__side"))
    rows = running(mine.filter(ok).unionByName(theirs, allowMissingColumns=True), [by], [c(at), c("__side"), c("__v")], {"__seen": (c("__side") == 0).cast("long")})
    told = rows.filter("__side = 0").select(c(by).alias("__by"), "__seen", c("__v").alias(value))
    found = rows.filter("__side = 1").drop("__v", "__side", "__place").withColumnRenamed(by, "__by").join(told, ["__by", "__seen"], "left").withColumnRenamed("__by", by)
    return found.select(*left.columns, value).unionByName(left.filter(~ok).select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias(value)))


@add("J-ASOF", "SELECT event_id, user_id, (SELECT max_by(b.value, (b.ts, b.value)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts AND b.value IS NOT NULL) AS value FROM events a WHERE event_type = 'click'")
def _(s, d):
    e = table(s, d, "events")
    clicks, buys = e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return as_of(clicks, buys, "user_id", "ts", "value").select("event_id", "user_id", "value")


# 2.4 groupings
@add("A-ROLLUP", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@add("A-CUBE", "SELECT research_tier, subject_type, count(*) AS n, grouping(research_tier) * 2 + grouping(subject_type) AS level FROM assertions GROUP BY CUBE (research_tier, subject_type)")
def _(s, d):
    return base.assertions(s, d).cube("research_tier", "subject_type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@add("A-GROUPING-SETS", "SELECT predicate, province, count(*) AS n FROM assertions GROUP BY GROUPING SETS ((predicate), (province), ())")
def _(s, d):
    a = base.assertions(s, d)
    return a.groupingSets([[c("predicate")], [c("province")], []], "predicate", "province").agg(F.count("*").alias("n"))


@add("A-APPROX-DISTINCT", "SELECT research_tier, true AS near FROM assertions GROUP BY 1")
def _(s, d):
    """Whether the sketch's estimate lies within a tenth of the exact number; the sketch merges before the shuffle."""
    a = base.assertions(s, d).groupBy("research_tier")
    return a.agg((F.abs(F.approx_count_distinct("subject_id", 0.02) - F.countDistinct("subject_id")) <= 0.1 * F.countDistinct("subject_id") + 1).alias("near"))


# 2.5 windows
@add("W-RANKS", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(3) OVER v AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate), v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(s, d):
    w, v = W.partitionBy("o_custkey").orderBy("o_orderdate"), W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(3).over(v).alias("third"))


@add("W-NEIGHBOURS", "SELECT o_orderkey, lag(o_orderdate) OVER v AS before, lead(o_orderdate) OVER v AS after, first_value(o_orderkey) OVER v AS first_order FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(s, d):
    v = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.lag("o_orderdate").over(v).alias("before"), F.lead("o_orderdate").over(v).alias("after"), F.first("o_orderkey").over(v).alias("first_order"))


@add("W-FRAMES", "SELECT o_orderkey, sum(o_totalprice) OVER (v ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, count(*) OVER (v ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS to_come FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(s, d):
    v = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.sum("o_totalprice").over(v.rowsBetween(-2, 0)).alias("last3"), F.count("*").over(v.rowsBetween(1, W.unboundedFollowing)).alias("to_come"))


# 2.7 sets
@add("U-EXCEPT", "SELECT fact_id FROM v2_assertion_scopes EXCEPT SELECT fact_id FROM research_assertions")
def _(s, d):
    return table(s, d, "v2_assertion_scopes").select("fact_id").subtract(table(s, d, "research_assertions").select("fact_id"))


@add("U-INTERSECT", "SELECT fact_id FROM research_event_cell_support INTERSECT SELECT fact_id FROM research_event_assertion_links")
def _(s, d):
    return table(s, d, "research_event_cell_support").select("fact_id").intersect(table(s, d, "research_event_assertion_links").select("fact_id"))


# 2.14 thresholds
FLOOR, RISK_WEIGHT, GATE_WEIGHT = 0.30, 1.0, 0.5


def _utility(n: Column, total: Column, errors: Column, violations: Column, safe: Column) -> Column:
    return safe / total - RISK_WEIGHT * errors / total - GATE_WEIGHT * violations / total


def learn_threshold(rows: DataFrame, by: list[str], steps: int = 20) -> DataFrame:
    """(by, threshold): of the grid 1/steps to 1 the lowest threshold of greatest utility among those that accept FLOOR of
    the rows; where none does, the lowest one that accepts most.

    rows: by, score, correct, gate. Rows are counted by the grid's cells first; a null score is never accepted.
    """
    cell = F.least(F.floor(c("score") * steps + 1e-9), F.lit(steps)).cast("int")
    safe = ((c("correct") == 1) & c("gate")).cast("int")
    at = rows.groupBy(*by, F.coalesce(cell, F.lit(0)).alias("cell")).agg(
        F.count("*").alias("n"), F.sum(1 - c("correct")).alias("errors"), F.sum((~c("gate")).cast("int")).alias("violations"), F.sum(safe).alias("safe")
    )
    grid = F.explode(F.sequence(F.lit(1), F.lit(steps)))
    up = at.select(*by, "cell", "n", "errors", "violations", "safe", grid.alias("step")).groupBy(*by, "step").agg(
        F.sum("n").alias("total"), *(F.sum(F.when(c("cell") >= c("step"), c(k)).otherwise(0)).alias(k) for k in ("errors", "violations", "safe")), F.sum(F.when(c("cell") >= c("step"), c("n")).otherwise(0)).alias("n")
    )
    u = F.round(_utility(c("n"), c("total"), c("errors"), c("violations"), c("safe")), 12)
    scored = up.select(*by, "step", (c("n") / c("total")).alias("coverage"), u.alias("u"))
    inside = c("coverage") >= FLOOR
    pick = F.coalesce(F.max(F.when(inside, F.struct("u", (-c("step")).alias("s"))))["s"], F.max(F.struct("coverage", (-c("step")).alias("s")))["s"])
    return scored.groupBy(*by).agg((-pick / steps).alias("threshold"))


_AT = "count(*) FILTER (score >= t) / count(*)::DOUBLE AS coverage, round((count(*) FILTER (score >= t AND correct = 1 AND gate) - 1.0 * count(*) FILTER (score >= t AND correct = 0) - 0.5 * count(*) FILTER (score >= t AND NOT gate)) / count(*), 12) AS u"


@add("M-LEARN-THRESHOLD", f"SELECT method, CASE WHEN max(coverage) >= 0.3 THEN arg_max(t, (u, -t)) FILTER (coverage >= 0.3) ELSE arg_max(t, (coverage, -t)) END AS threshold FROM (SELECT method, t, {_AT} FROM ({analytics._RUN}), (SELECT unnest(range(1, 21))::DOUBLE / 20 AS t) GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    return learn_threshold(analytics.runs(s, d).select("method", "score", "correct", "gate"), ["method"])


def learn_tau(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, tau): the same over the rows' own risks and 0: rows up to tau are accepted, the lowest best tau counts.

    rows: by, risk, correct, gate. Running counts go over the distinct risks, however many there are.
    """
    safe = ((c("correct") == 1) & c("gate")).cast("int")
    at = rows.groupBy(*by, "risk").agg(F.count("*").alias("n"), F.sum(1 - c("correct")).alias("e"), F.sum((~c("gate")).cast("int")).alias("v"), F.sum(safe).alias("k"))
    zero = rows.select(*by).distinct().select(*by, F.lit(0.0).alias("risk"), *(F.lit(0).cast("long").alias(k) for k in "nevk"))
    at = at.unionByName(zero).groupBy(*by, "risk").agg(*(F.sum(k).alias(k) for k in "nevk"))
    up = running(at, by, [c("risk")], {"cn": c("n"), "ce": c("e"), "cv": c("v"), "ck": c("k")})
    total = at.groupBy(*by).agg(F.sum("n").alias("total"))
    u = F.round(_utility(c("cn"), c("total"), c("ce"), c("cv"), c("ck")), 12)
    scored = up.join(total, by).select(*by, "risk", (c("cn") / c("total")).alias("coverage"), u.alias("u"))
    best = F.max(F.when(c("coverage") >= FLOOR, F.struct("u", (-c("risk")).alias("t"))))["t"]
    return scored.groupBy(*by).agg(F.round(-F.coalesce(best, F.max(F.struct("coverage", (-c("risk")).alias("t")))["t"]), 9).alias("tau"))


_RISKS = f"SELECT *, round(1 - score, 2) AS risk FROM ({analytics._RUN})"


@add("M-TAU-ACCEPT", f"SELECT method, round(CASE WHEN max(coverage) >= 0.3 THEN arg_max(t, (u, -t)) FILTER (coverage >= 0.3) ELSE arg_max(t, (coverage, -t)) END, 9) AS tau FROM (SELECT r.method, t, {_AT.replace('score >= t', 'risk <= t')} FROM ({_RISKS}) r JOIN (SELECT DISTINCT method, risk AS t FROM ({_RISKS}) UNION SELECT DISTINCT method, 0.0 FROM ({_RISKS})) g ON g.method = r.method GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    rows = analytics.runs(s, d).select("method", F.round(1 - c("score"), 2).alias("risk"), "correct", "gate")
    return learn_tau(rows, ["method"])


@add("COV@RISK", f"SELECT method, round(max(coverage), 9) AS coverage FROM ({analytics._CURVE}) WHERE coverage = 0 OR risk <= 0.5 GROUP BY 1")
def _(s, d, target=0.5):
    """The greatest coverage whose risk stays within the target; 0 where none does."""
    curve = analytics.stats.risk_coverage(analytics.runs(s, d), ["method"])
    return curve.filter((c("coverage") == 0) | (c("risk") <= target)).groupBy("method").agg(F.round(F.max("coverage"), 9).alias("coverage"))


GRID = "(SELECT unnest(range(1, 21))::DOUBLE / 20 AS t)"


@add("M-RC-CONSTRAINED", f"SELECT method, t, round(count(*) FILTER (score >= t AND gate) / count(*)::DOUBLE, 9) AS coverage, round(count(*) FILTER (score >= t AND gate AND correct = 0) / nullif(count(*) FILTER (score >= t AND gate), 0)::DOUBLE, 9) AS risk FROM ({analytics._RUN}), {GRID} GROUP BY 1, 2")
def _(s, d, steps=20):
    """The curve over a fixed grid where only rows inside the gate can be accepted; null risk where none is."""
    cell = F.least(F.floor(c("score") * steps + 1e-9), F.lit(steps)).cast("int")
    at = analytics.runs(s, d).groupBy("method", cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(c("gate").cast("int")).alias("g"), F.sum((c("gate") & (c("correct") == 0)).cast("int")).alias("e"))
    inside = lambda k: F.sum(F.when(c("cell") >= c("step"), c(k)).otherwise(0))
    up = at.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).groupBy("method", "step").agg(F.sum("n").alias("n"), inside("g").alias("g"), inside("e").alias("e"))
    return up.select("method", (c("step") / steps).alias("t"), F.round(c("g") / c("n"), 9).alias("coverage"), F.round(F.when(c("g") > 0, c("e") / F.when(c("g") > 0, c("g"))), 9).alias("risk"))


@add("M-MATCHED-COV", f"SELECT method, t AS coverage, round(arg_max(risk, coverage), 9) AS risk FROM ({analytics._CURVE}), {GRID} WHERE coverage <= t + 1e-12 GROUP BY 1, 2")
def _(s, d, steps=20):
    """Each method's risk at the same coverages: that of its curve's last point not beyond. A point is copied to the grid's
    places up to the next point only, of which there are steps at most."""
    curve = analytics.stats.risk_coverage(analytics.runs(s, d), ["method"])
    first = F.greatest(F.ceil((c("coverage") - 1e-12) * steps), F.lit(1)).cast("int")
    best = curve.groupBy("method", first.alias("first")).agg(F.max_by("risk", "coverage").alias("risk"), F.max("coverage").alias("at"))
    grid = best.select("method", "risk", "at", F.explode(F.sequence("first", F.lit(steps))).alias("step"))
    return grid.groupBy("method", "step").agg(F.round(F.max_by("risk", "at"), 9).alias("risk")).select("method", (c("step") / steps).alias("coverage"), "risk")


# 2.8
@add("F-HASH-ID-VARIANTS", r"SELECT fact_id, 'N-' || substr(sha256(coalesce(province, '') || chr(31) || coalesce(predicate, '')), 1, 24) AS id_nulls, 'S-' || substr(sha256(trim(regexp_replace(coalesce(subject_name, ''), '[ \t\n\r]+', ' ', 'g')) || chr(31) || trim(regexp_replace(coalesce(object_name, ''), '[ \t\n\r]+', ' ', 'g'))), 1, 24) AS id_spaces FROM assertions")
def _(s, d):
    return base.assertions(s, d).select("fact_id", X.stable_id_nulls("N", c("province"), c("predicate")).alias("id_nulls"), X.stable_id_spaces("S", c("subject_name"), c("object_name")).alias("id_spaces"))


@add("F-RANDOM", "SELECT fact_id FROM assertions WHERE ('0x' || substr(sha256('seed-7' || chr(31) || fact_id), 1, 12))::BIGINT / 281474976710656.0 < 0.1")
def _(s, d, seed="seed-7", share=0.1):
    """A sample that the seed alone decides, whatever the order and partitioning of the rows."""
    return base.assertions(s, d).filter(X.hash_uniform(F.lit(seed), "fact_id") < share).select("fact_id")


@add("G-MERGE", "SELECT id, arg_max(name, rank) AS name, arg_max(kind, rank) AS kind FROM (SELECT entity_id AS id, canonical_name AS name, 'entity' AS kind, 0 AS rank FROM entities UNION ALL SELECT event_id, event_name, 'event', 1 FROM frames UNION ALL SELECT state_id, culture_subject_name, 'state', 2 FROM states) GROUP BY 1")
def _(s, d):
    """Nodes of several layers by id; of equal ids the later layer's node counts, whole."""
    node = lambda df, k, name, kind, rank: df.select(c(k).alias("id"), F.struct(F.lit(rank).alias("rank"), c(name).alias("name"), F.lit(kind).alias("kind")).alias("v"))
    every = node(base.entities(s, d), "entity_id", "canonical_name", "entity", 0).unionByName(node(base.frames(s, d), "event_id", "event_name", "event", 1)).unionByName(node(base.states(s, d), "state_id", "culture_subject_name", "state", 2))
    return every.groupBy("id").agg(F.max_by("v", "v.rank").alias("v")).select("id", "v.name", "v.kind")


@add("D70-RANDOM", "SELECT fact_id, CASE WHEN ('0x' || substr(sha256('split-1' || chr(31) || fact_id), 1, 12))::BIGINT / 281474976710656.0 < 0.2 THEN 'heldout' ELSE 'train' END AS split FROM assertions")
def _(s, d):
    """The random split: a fifth of the facts by hash, the same on every run."""
    u = X.hash_uniform(F.lit("split-1"), "fact_id")
    return base.assertions(s, d).select("fact_id", F.when(u < 0.2, "heldout").otherwise("train").alias("split"))


_TASKS = "SELECT DISTINCT task_id AS a, 'component ' || component_id AS b FROM closure3_old_new_heldout WHERE task_id IS NOT NULL AND component_id IS NOT NULL"


@add("D70-GROUPED", f"WITH RECURSIVE e AS ({_TASKS}), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, w) AS (SELECT a, a FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.w), roots AS (SELECT a, min(w) AS root FROM reach GROUP BY 1) SELECT task_id, CASE WHEN ('0x' || substr(sha256('split-2' || chr(31) || coalesce(root, task_id)), 1, 12))::BIGINT / 281474976710656.0 < 0.2 THEN 'heldout' ELSE 'train' END AS split FROM (SELECT DISTINCT task_id FROM closure3_old_new_heldout WHERE task_id IS NOT NULL) LEFT JOIN roots ON a = task_id")
def _(s, d):
    """The grouped split: all tasks linked by components fall on one side, by hash of their group's smallest id."""
    t = table(s, d, "closure3_old_new_heldout").filter("task_id is not null")
    roots = components(t.select(c("task_id").alias("a"), F.concat(F.lit("component "), "component_id").alias("b"))).select(c("vertex").alias("task_id"), c("component").alias("root"))
    u = X.hash_uniform(F.lit("split-2"), F.coalesce("root", "task_id"))
    return t.select("task_id").distinct().join(roots, "task_id", "left").select("task_id", F.when(u < 0.2, "heldout").otherwise("train").alias("split"))


@add("M-CLOPPER-PEARSON")
def _(s, d):
    """Exact bounds of each method's accuracy; one row per method comes to the driver, and methods are few."""
    rows = analytics.runs(s, d).groupBy("method").agg(F.sum("correct").alias("k"), F.count("*").alias("n")).collect()
    out = [(r["method"], *(round(x, 6) for x in analytics.stats.clopper_pearson(int(r["k"]), int(r["n"])))) for r in rows]
    return s.createDataFrame(out, "method string, low double, high double")


# 2.9 components
@add("D69", "WITH RECURSIVE e AS (SELECT DISTINCT event_id AS a, 'cell ' || cell_id AS b FROM links l JOIN cell_support u ON u.fact_id = l.fact_id), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, w) AS (SELECT a, a FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.w) SELECT a AS vertex, min(w) AS component FROM reach GROUP BY 1")
def _(s, d):
    """Components of the bipartite graph of events and the cells that their facts support."""
    e = base.links(s, d).select("event_id", "fact_id").join(base.cell_support(s, d).select("fact_id", "cell_id"), "fact_id")
    return components(e.select(c("event_id").alias("a"), F.concat(F.lit("cell "), "cell_id").alias("b")))


SQL["D69"] = SQL["D69"].replace("\nWITH RECURSIVE e AS", ", e AS").replace("WITH ", "WITH RECURSIVE ", 1)
