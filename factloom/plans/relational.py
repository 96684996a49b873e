"""Relational constructs of sections 2.2 to 2.8 of the survey, each under its Id, with SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators.pairs import pairs_within
from factloom.operators.ranks import running
from factloom.plans import base
from factloom.plans.base import over
from factloom.session import table
from factloom.sources.writers import digest_of

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


def facts(s, d) -> DataFrame:
    return base.assertions(s, d)


def by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


# 2.2 projections and filters
@add("PRJ-ALIAS", "SELECT fact_id AS id, subject_id AS owner, coalesce(confidence, 0) * 100 AS percent FROM assertions")
def _(s, d):
    return facts(s, d).select(c("fact_id").alias("id"), c("subject_id").alias("owner"), (F.coalesce("confidence", F.lit(0.0)) * 100).alias("percent"))


@add("PRJ-CASE-SIMPLE", "SELECT fact_id, CASE time_precision WHEN 'year' THEN 1 WHEN 'month' THEN 2 ELSE 0 END AS grain FROM assertions")
def _(s, d):
    return facts(s, d).select("fact_id", F.when(c("time_precision") == "year", 1).when(c("time_precision") == "month", 2).otherwise(0).alias("grain"))


@add("PRJ-CASE-SEARCHED", "SELECT fact_id, CASE WHEN subject_type = 'Event' THEN object_id WHEN object_type = 'Event' THEN subject_id END AS counterpart FROM assertions")
def _(s, d):
    return facts(s, d).select("fact_id", F.when(c("subject_type") == "Event", c("object_id")).when(c("object_type") == "Event", c("subject_id")).alias("counterpart"))


@add("PRJ-COALESCE", "SELECT fact_id, coalesce(merged_into, fact_id) AS canonical, nullif(time_precision, 'unknown') AS known_precision, ifnull(province, '-') AS place FROM assertions")
def _(s, d):
    return facts(s, d).select("fact_id", F.coalesce("merged_into", "fact_id").alias("canonical"), F.nullif("time_precision", F.lit("unknown")).alias("known_precision"), F.ifnull("province", F.lit("-")).alias("place"))


@add("PRJ-CONST", "SELECT 'assertions' AS source, count(*) AS n FROM assertions UNION ALL SELECT 'entities', count(*) FROM entities")
def _(s, d):
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
    return one("assertions", facts(s, d)).unionByName(one("entities", base.entities(s, d)))


@add("FLT-EQ", "SELECT fact_id FROM assertions WHERE research_tier = 'strict_semantic' AND predicate IN ('led', 'trained') AND risk_tier <> 'D'")
def _(s, d):
    return facts(s, d).filter((c("research_tier") == "strict_semantic") & c("predicate").isin("led", "trained") & (c("risk_tier") != "D")).select("fact_id")


@add("FLT-ISNULL", "SELECT fact_id FROM assertions WHERE province IS NULL AND canonical_space_anchor_id IS NOT NULL")
def _(s, d):
    return facts(s, d).filter(c("province").isNull() & c("canonical_space_anchor_id").isNotNull()).select("fact_id")


@add("FLT-NULLSAFE-NEQ", "SELECT a.fact_id FROM assertions a JOIN (SELECT fact_id, max(semantic_status) AS st, max(risk_tier) AS rt FROM v2_assertion_scopes GROUP BY 1) v ON v.fact_id = a.fact_id WHERE a.semantic_status IS DISTINCT FROM v.st OR a.risk_tier IS DISTINCT FROM v.rt")
def _(s, d):
    """What differs between the scope table and the assertions."""
    v = table(s, d, "v2_assertion_scopes").groupBy("fact_id").agg(F.max("semantic_status").alias("st"), F.max("risk_tier").alias("rt"))
    return facts(s, d).join(v, "fact_id").filter(~c("semantic_status").eqNullSafe(c("st")) | ~c("risk_tier").eqNullSafe(c("rt"))).select("fact_id")


QUERIES["D25"], SQL["D25"] = QUERIES["FLT-NULLSAFE-NEQ"], SQL["FLT-NULLSAFE-NEQ"]


@add("FLT-LIKE", "SELECT fact_id, predicate ILIKE 'raw:%' AS raw, subject_name ILIKE '%county%' AS county FROM assertions WHERE predicate ILIKE 'raw:%' OR subject_name ILIKE '%county%'")
def _(s, d):
    raw, county = c("predicate").ilike("raw:%"), c("subject_name").ilike("%county%")
    return facts(s, d).filter(raw | county).select("fact_id", raw.alias("raw"), county.alias("county"))


def glob(pattern: str) -> str:
    """A glob of *, ? and [...] (with ! or ^ for all but) as a regular expression of the whole text; a [ without end is itself."""
    out, i = "^(?s:", 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in ("!", "^"))) if ch == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            out += "[" + ("^" if negated else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:]) + "]"
            i = end
        else:
            out += ".*" if ch == "*" else "." if ch == "?" else re.escape(ch)
        i += 1
    return out + ")$"


@add("FLT-GLOB", "SELECT fact_id FROM assertions WHERE time_start GLOB '*年*[0-9]?日' OR predicate GLOB 'raw:*' OR predicate GLOB '[!a-m]*_[a-z]?'")
def _(s, d):
    match = lambda k, p: c(k).rlike(glob(p))
    return facts(s, d).filter(match("time_start", "*年*[0-9]?日") | match("predicate", "raw:*") | match("predicate", "[!a-m]*_[a-z]?")).select("fact_id")


@add("FLT-REGEX", r"SELECT fact_id FROM assertions WHERE regexp_full_match(time_start, '\d{4}(-\d{2}(-\d{2})?)?')")
def _(s, d):
    return facts(s, d).filter(c("time_start").rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$")).select("fact_id")


@add("FLT-RANGE-PARAM", "SELECT fact_id FROM assertions WHERE coalesce(time_start, time_end, '') >= '1930' AND coalesce(time_end, time_start, '9') <= '1945-12-31'")
def _(s, d, t0="1930", t1="1945-12-31"):
    return facts(s, d).filter((F.coalesce("time_start", "time_end", F.lit("")) >= t0) & (F.coalesce("time_end", "time_start", F.lit("9")) <= t1)).select("fact_id")


@add("FLT-PARAM-OR-ANY", "SELECT fact_id FROM assertions WHERE time_precision = 'month'")
def _(s, d, precision="month", role=""):
    out = facts(s, d)
    for column, value in (("time_precision", precision), ("time_role", role)):
        out = out.filter(c(column) == value) if value else out
    return out.select("fact_id")


@add("FLT-CROSS-COL-OR", "SELECT fact_id, e.entity_id FROM assertions a JOIN (SELECT entity_id FROM entities WHERE risk_tier = 'D') e ON e.entity_id = subject_id OR e.entity_id = object_id")
def _(s, d):
    """As a union of two equi-joins; a fact with one entity at both ends counts once."""
    e = base.entities(s, d).filter("risk_tier = 'D'").select("entity_id")
    end = lambda k: facts(s, d).select("fact_id", c(k).alias("entity_id")).join(e, "entity_id").select("fact_id", "entity_id")
    return end("subject_id").union(end("object_id")).distinct()


@add("VIEW-TIER", "SELECT fact_id, research_tier FROM assertions WHERE research_tier = 'strict_semantic' AND merged_into IS NULL")
def _(s, d):
    facts(s, d).createOrReplaceTempView("factloom_assertions")
    s.sql("CREATE OR REPLACE TEMP VIEW factloom_strict AS SELECT * FROM factloom_assertions WHERE research_tier = 'strict_semantic' AND merged_into IS NULL")
    return s.table("factloom_strict").select("fact_id", "research_tier")


# 2.3 joins
@add("J-INNER-USING", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(s, d):
    return by(table(s, d, "orders").withColumnRenamed("o_orderkey", "k").join(table(s, d, "lineitem").select(c("l_orderkey").alias("k")), "k"), "o_orderpriority")


@add("J-INNER-ON", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    cu, n = table(s, d, "customer"), table(s, d, "nation")
    return by(cu.join(n, cu.c_nationkey == n.n_nationkey), "n_name")


@add("J-MULTIKEY", "SELECT a.state_id AS a, b.state_id AS b FROM states a JOIN states b ON a.culture_subject_id = b.culture_subject_id AND a.culture_form_code = b.culture_form_code AND a.stage_code = b.stage_code AND a.region_id = b.region_id")
def _(s, d):
    keys = ["culture_subject_id", "culture_form_code", "stage_code", "region_id"]
    return pairs_within(base.states(s, d).select(*keys, c("state_id").alias("id")), keys, F.lit(True)).select(c("a_id").alias("a"), c("b_id").alias("b"))


@add("J-LEFT", "SELECT a.fact_id, count(c.cell_id) AS n FROM assertions a LEFT JOIN cell_support c ON c.fact_id = a.fact_id GROUP BY 1")
def _(s, d):
    return facts(s, d).select("fact_id").join(base.cell_support(s, d), "fact_id", "left").groupBy("fact_id").agg(F.count("cell_id").alias("n"))


@add("J-LEFT-MULTI", "SELECT e.entity_id, coalesce(a.n, 0) AS as_subject, coalesce(b.n, 0) AS as_object, coalesce(l.n, 0) AS as_event, coalesce(t.n, 0) AS as_state FROM entities e LEFT JOIN (SELECT subject_id AS k, count(*) AS n FROM assertions GROUP BY 1) a ON a.k = e.entity_id LEFT JOIN (SELECT object_id AS k, count(*) AS n FROM assertions GROUP BY 1) b ON b.k = e.entity_id LEFT JOIN (SELECT event_id AS k, count(*) AS n FROM links GROUP BY 1) l ON l.k = e.entity_id LEFT JOIN (SELECT culture_subject_id AS k, count(*) AS n FROM states GROUP BY 1) t ON t.k = e.entity_id")
def _(s, d):
    out, names = base.entities(s, d).select("entity_id"), ["as_subject", "as_object", "as_event", "as_state"]
    for name, df, k in zip(names, (facts(s, d), facts(s, d), base.links(s, d), base.states(s, d)), ("subject_id", "object_id", "event_id", "culture_subject_id"), strict=True):
        out = out.join(df.groupBy(c(k).alias("entity_id")).agg(F.count("*").alias(name)), "entity_id", "left")
    return out.na.fill(0, names)


@add("J-SELF-DUAL", "SELECT n1.n_name AS customer_nation, n2.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN nation n2 ON n2.n_nationkey = s_nationkey GROUP BY 1, 2")
def _(s, d):
    n = table(s, d, "nation")
    cu = table(s, d, "customer").join(n, c("c_nationkey") == c("n_nationkey")).select("c_custkey", c("n_name").alias("customer_nation"))
    su = table(s, d, "supplier").join(n, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", c("n_name").alias("supplier_nation"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(cu, c("c_custkey") == c("o_custkey"))
    l = table(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(su, c("s_suppkey") == c("l_suppkey"))
    return by(l.join(o, c("l_orderkey") == c("o_orderkey")), "customer_nation", "supplier_nation")


@add("J-STAR", "SELECT r_name, p_brand, c_mktsegment, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3")
def _(s, d):
    """Dimensions are broadcast or not by the optimizer's check of their size."""
    t = lambda n: table(s, d, n)
    place = t("nation").join(t("region"), c("n_regionkey") == c("r_regionkey"))
    who = t("customer").join(place, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    rows = t("lineitem").join(t("part").select("p_partkey", "p_brand"), c("p_partkey") == c("l_partkey")).join(t("orders"), c("o_orderkey") == c("l_orderkey")).join(who, c("c_custkey") == c("o_custkey"))
    return rows.groupBy("r_name", "p_brand", "c_mktsegment").agg(F.sum("l_quantity").alias("quantity"))


@add("J-CROSS-SCALAR", "SELECT predicate, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM assertions), 6) AS share FROM assertions GROUP BY 1")
def _(s, d):
    """A one-row total as a window over the few grouped rows."""
    return by(facts(s, d), "predicate").withColumn("share", F.round(c("n") / F.sum("n").over(W.partitionBy()), 6))


@add("J-SEMI-EXISTS", "SELECT state_id FROM states s WHERE EXISTS (SELECT 1 FROM state_support u JOIN assertions a ON a.fact_id = u.fact_id WHERE u.state_id = s.state_id AND a.research_tier = 'strict_semantic')")
def _(s, d):
    strict = facts(s, d).filter("research_tier = 'strict_semantic'").select("fact_id")
    return base.states(s, d).select("state_id").join(base.state_support(s, d).join(strict, "fact_id", "left_semi"), "state_id", "left_semi")


@add("J-SEMI-IN", "SELECT fact_id FROM assertions WHERE subject_id IN (SELECT event_id FROM links)")
def _(s, d):
    return facts(s, d).join(base.links(s, d), c("subject_id") == c("event_id"), "left_semi").select("fact_id")


@add("J-ANTI", "SELECT fact_id FROM assertions a WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.fact_id = a.fact_id)")
def _(s, d):
    return facts(s, d).select("fact_id").join(base.links(s, d).select("fact_id"), "fact_id", "left_anti")


@add("J-THETA-SELF-ORDERED", "SELECT a.fact_id AS a, b.fact_id AS b FROM assertions a JOIN assertions b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.object_id = b.object_id AND a.fact_id < b.fact_id")
def _(s, d):
    keys = ["subject_id", "predicate", "object_id"]
    return pairs_within(facts(s, d).select(*keys, c("fact_id").alias("id")), keys, c("a_id") < c("b_id")).select(c("a_id").alias("a"), c("b_id").alias("b"))


@add("J-THETA-STAGE", "SELECT a.state_id AS earlier, b.state_id AS later FROM states a JOIN states b ON a.culture_subject_id = b.culture_subject_id AND a.culture_form_code = b.culture_form_code AND a.region_id <> b.region_id AND a.stage_order < b.stage_order")
def _(s, d):
    keys = ["culture_subject_id", "culture_form_code"]
    rows = base.states(s, d).select(*keys, c("state_id").alias("id"), "stage_order", "region_id")
    later = (c("a_stage_order") < c("b_stage_order")) & (c("a_region_id") != c("b_region_id"))
    return pairs_within(rows, keys, later).select(c("a_id").alias("earlier"), c("b_id").alias("later"))


@add("J-INTERVAL-OVERLAP", "SELECT fact_id, stage_order, overlap_start, overlap_end FROM stage_memberships")
def _(s, d):
    return base.stage_memberships(s, d)


@add("J-LOOKUP-MAP", "SELECT l.event_id, l.fact_id, coalesce(role_code, 'other') AS role FROM links l LEFT JOIN roles r ON r.event_id = l.event_id AND r.fact_id = l.fact_id AND r.counterpart_id IS NOT DISTINCT FROM l.counterpart_id GROUP BY ALL")
def _(s, d):
    known = F.create_map(*[F.lit(x) for kv in base.ROLES.items() for x in kv])
    role = F.when(c("semantic_route") == "strict_controlled", known[c("predicate")])
    return base.links(s, d).select("event_id", "fact_id", F.coalesce(role, F.lit("other")).alias("role")).distinct()


@add("J-HASH-UNION-KEY", "SELECT k AS entity_id, count(*) AS n FROM (SELECT subject_id AS k FROM assertions UNION ALL SELECT object_id FROM assertions) WHERE k IS NOT NULL GROUP BY 1")
def _(s, d):
    return by(facts(s, d).select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).dropna(), "entity_id")


@add("J-DYNAMIC-COL", "SELECT predicate, e, count(DISTINCT k) AS n FROM (SELECT predicate, 'subject' AS e, subject_id AS k FROM assertions WHERE predicate IN ('led', 'trained') UNION ALL SELECT predicate, 'object', object_id FROM assertions WHERE predicate IN ('part_of', 'member_of')) JOIN states ON culture_subject_id = k GROUP BY 1, 2")
def _(s, d):
    """The rule names the endpoint: facts are melted to (fact, endpoint, entity) and meet the rule there."""
    rules = s.createDataFrame([("led", "subject"), ("trained", "subject"), ("part_of", "object"), ("member_of", "object")], "predicate string, e string")
    melted = facts(s, d).select("predicate", F.expr("stack(2, 'subject', subject_id, 'object', object_id) as (e, k)"))
    hit = melted.join(F.broadcast(rules), ["predicate", "e"]).join(base.states(s, d).select(c("culture_subject_id").alias("k")).distinct(), "k")
    return hit.groupBy("predicate", "e").agg(F.countDistinct("k").alias("n"))


@add("J-BRIDGE-CHAIN", "SELECT e.source_entity_type AS kind, count(DISTINCT c.cell_id) AS cells, count(DISTINCT region_id) AS regions FROM entities e JOIN assertions a ON a.subject_id = e.entity_id JOIN cell_support c ON c.fact_id = a.fact_id JOIN fact_regions r ON r.fact_id = a.fact_id GROUP BY 1")
def _(s, d):
    f = facts(s, d).select("fact_id", c("subject_id").alias("entity_id"))
    rows = base.entities(s, d).select("entity_id", c("source_entity_type").alias("kind")).join(f, "entity_id").join(base.cell_support(s, d), "fact_id").join(base.fact_regions(s, d), "fact_id")
    return rows.groupBy("kind").agg(F.countDistinct("cell_id").alias("cells"), F.countDistinct("region_id").alias("regions"))


# 2.4 aggregations
@add("A-COUNT", "SELECT l_returnflag, count(*) AS n, sum(l_quantity)::DOUBLE AS q, min(l_shipdate) AS first, max(l_shipdate) AS last, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.round(F.avg("l_discount"), 6).alias("discount"))


@add("A-COUNT-DISTINCT", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@add("A-COUNT-DISTINCT-CASE", "SELECT semantic_route, count(DISTINCT CASE WHEN counterpart_type = 'Person' THEN counterpart_id END) AS persons FROM links GROUP BY 1")
def _(s, d):
    return base.links(s, d).groupBy("semantic_route").agg(F.countDistinct(F.when(c("counterpart_type") == "Person", c("counterpart_id"))).alias("persons"))


@add("A-COUNT-DISTINCT-PAIR", "SELECT predicate, count(DISTINCT subject_id || chr(31) || object_id) AS pairs FROM assertions GROUP BY 1")
def _(s, d):
    return facts(s, d).groupBy("predicate").agg(F.countDistinct("subject_id", "object_id").alias("pairs"))


@add("A-SUM-CASE", "SELECT risk_tier, sum(CASE WHEN province IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_place, sum(CASE WHEN confidence >= 0.8 THEN 1 ELSE 0 END)::BIGINT AS sure FROM assertions GROUP BY 1")
def _(s, d):
    one = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return facts(s, d).groupBy("risk_tier").agg(one(c("province").isNull()).alias("no_place"), one(c("confidence") >= 0.8).alias("sure"))


@add("A-MAX-BOOL", "SELECT culture_subject_id, max((observation_tier = 'trusted_event_spacetime')::INTEGER) = 1 AS any_trusted FROM states GROUP BY 1")
def _(s, d):
    return base.states(s, d).groupBy("culture_subject_id").agg(F.bool_or(c("observation_tier") == "trusted_event_spacetime").alias("any_trusted"))


@add("A-SHARE", "WITH t AS (SELECT subject_type, count(*)::DOUBLE AS total FROM assertions GROUP BY 1) SELECT a.subject_type, research_tier, count(*) AS n, round(count(*) / t.total, 6) AS share FROM assertions a JOIN t ON t.subject_type = a.subject_type GROUP BY 1, 2, t.total")
def _(s, d):
    return by(facts(s, d), "subject_type", "research_tier").withColumn("share", F.round(c("n") / F.sum("n").over(W.partitionBy("subject_type")), 6))


SQL["A-SHARE"] = SQL["A-SHARE"].replace("\nWITH t AS", ", t AS")


@add("A-RATIO-OF-COUNTS", "SELECT support_role, round(count(*)::DOUBLE / count(DISTINCT fact_id), 6) AS per_fact FROM cell_support GROUP BY 1")
def _(s, d):
    return base.cell_support(s, d).groupBy("support_role").agg(F.round(F.count("*") / F.countDistinct("fact_id"), 6).alias("per_fact"))


@add("A-HAVING", "SELECT event_id, count(DISTINCT fact_id) AS n FROM links WHERE occurrence_time_start IS NOT NULL GROUP BY 1 HAVING count(DISTINCT fact_id) >= 2 AND count(DISTINCT substr(occurrence_time_start, 1, 4)) = 1")
def _(s, d):
    """At least two dated facts that agree on the year."""
    g = base.links(s, d).filter("occurrence_time_start is not null").groupBy("event_id").agg(F.countDistinct("fact_id").alias("n"), F.countDistinct(F.substring("occurrence_time_start", 1, 4)).alias("y"))
    return g.filter("n >= 2 and y = 1").select("event_id", "n")


QUERIES["D28"], SQL["D28"] = QUERIES["A-HAVING"], SQL["A-HAVING"]


@add("A-GROUP-EXPR", "SELECT substr(time_start, 1, 4) AS y, count(*) AS n FROM assertions GROUP BY 1")
def _(s, d):
    return by(facts(s, d), F.substring("time_start", 1, 4).alias("y"))


@add("A-SUM-OF-DISTINCTS", "SELECT stage_code, sum(k)::BIGINT AS n FROM (SELECT stage_code, region_id, count(DISTINCT culture_subject_id) AS k FROM states GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    return base.states(s, d).groupBy("stage_code", "region_id").agg(F.countDistinct("culture_subject_id").alias("k")).groupBy("stage_code").agg(F.sum("k").alias("n"))


@add("A-COLLECT-LIST", "SELECT state_id, array_to_string(list_sort(list(DISTINCT fact_id)), ',') AS facts FROM state_support GROUP BY 1")
def _(s, d):
    return base.state_support(s, d).groupBy("state_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("fact_id"))).alias("facts"))


@add("A-SET-UNION", "SELECT source_entity_type, canonical_name, list_sort(list(DISTINCT a)) AS aliases FROM (SELECT source_entity_type, canonical_name, unnest(from_json(aliases_json, '[\"VARCHAR\"]')) AS a FROM entities) WHERE a <> canonical_name GROUP BY 1, 2")
def _(s, d):
    """The sorted union of the aliases of all records of one name, without the name itself."""
    a = base.entities(s, d).select("source_entity_type", "canonical_name", F.explode(F.from_json("aliases_json", "array<string>")).alias("a")).filter("a <> canonical_name")
    return a.groupBy("source_entity_type", "canonical_name").agg(F.array_sort(F.collect_set("a")).alias("aliases"))


QUERIES["D26"], SQL["D26"] = QUERIES["A-SET-UNION"], SQL["A-SET-UNION"]


@add("A-MIN-OR-NULL", "SELECT canonical_name, min(confidence) AS least, bool_and(semantic_status = 'auto_accepted') AS validated FROM entities GROUP BY 1")
def _(s, d):
    return base.entities(s, d).groupBy("canonical_name").agg(F.min("confidence").alias("least"), F.bool_and(c("semantic_status") == "auto_accepted").alias("validated"))


@add("A-MODE", "SELECT subject_type, predicate AS usual FROM (SELECT subject_type, predicate, row_number() OVER (PARTITION BY subject_type ORDER BY count(*) DESC, predicate) AS rn FROM assertions GROUP BY 1, 2) WHERE rn = 1")
def _(s, d):
    """Ties go to the smallest value."""
    n = by(facts(s, d), "subject_type", "predicate")
    return n.groupBy("subject_type").agg(F.min(F.struct((-c("n")).alias("n"), "predicate")).alias("x")).select("subject_type", c("x.predicate").alias("usual"))


@add("A-TOP-K-TOKENS", "SELECT lang, w, n FROM (SELECT lang, w, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS rn FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) GROUP BY 1, 2) WHERE rn <= 80")
def _(s, d):
    """The 80 most common words of each language: a top-k report."""
    words = table(s, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "w"))
    return by(words, "lang", "w").withColumn("rn", rank).filter("rn <= 80").select("lang", "w", "n")


@add("A-HISTOGRAM", "SELECT semantic_status, count(*) AS n FROM entities GROUP BY 1")
def _(s, d):
    return by(base.entities(s, d), "semantic_status")


@add("A-NAME-TYPE-CARD", "SELECT canonical_name, count(DISTINCT source_entity_type) AS n FROM entities GROUP BY 1 HAVING count(DISTINCT source_entity_type) > 1")
def _(s, d):
    return base.entities(s, d).groupBy("canonical_name").agg(F.countDistinct("source_entity_type").alias("n")).filter("n > 1")


@add("A-COVERAGE-RATES", "SELECT round(avg((time_role <> 'unknown')::INTEGER), 6) AS time_role_rate, round(avg((space_role <> 'unknown')::INTEGER), 6) AS space_role_rate, round(avg((province IS NOT NULL)::INTEGER), 6) AS place_rate FROM assertions")
def _(s, d):
    rate = lambda x: F.round(F.avg(x.cast("int")), 6)
    return facts(s, d).agg(rate(c("time_role") != "unknown").alias("time_role_rate"), rate(c("space_role") != "unknown").alias("space_role_rate"), rate(c("province").isNotNull()).alias("place_rate"))


# 2.5 windows, 2.6 sorts
@add("W-LATEST", "SELECT fact_id, merged_into FROM assertions")
def _(s, d):
    return facts(s, d).select("fact_id", "merged_into")


@add("W-STRATIFIED-TOPN", "SELECT predicate, research_tier, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY predicate, research_tier ORDER BY sha256(fact_id), fact_id) AS r FROM assertions) WHERE r <= 3")
def _(s, d):
    """A sample of three per stratum, ordered by hash."""
    r = F.row_number().over(W.partitionBy("predicate", "research_tier").orderBy(F.sha2("fact_id", 256), "fact_id"))
    return facts(s, d).select("predicate", "research_tier", "fact_id", r.alias("r")).filter("r <= 3").drop("r")


@add("W-RANK-PREFIX", "SELECT fact_id, row_number() OVER (PARTITION BY subject_type ORDER BY sha256(fact_id), fact_id) <= round(0.8 * count(*) OVER (PARTITION BY subject_type)) AS train FROM assertions")
def _(s, d):
    rows = running(facts(s, d).select("subject_type", "fact_id", F.sha2("fact_id", 256).alias("h")), ["subject_type"], [c("h"), c("fact_id")], totals=True)
    return rows.select("fact_id", (c("__place") <= F.round(0.8 * c("__n"))).alias("train"))


@add("W-SYSTEMATIC", "SELECT book_id, doc_id FROM (SELECT book_id, doc_id, row_number() OVER (PARTITION BY book_id ORDER BY page_no, doc_id) AS r FROM documents) WHERE r % 10 = 1")
def _(s, d):
    """A systematic sample: every tenth page of each book."""
    rows = running(table(s, d, "documents").select("book_id", "doc_id", "page_no"), ["book_id"], [F.asc_nulls_last("page_no"), c("doc_id")])
    return rows.filter("__place % 10 = 1").select("book_id", "doc_id")


@add("S-MULTI", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@add("S-CASE", "SELECT entity_id FROM entities ORDER BY CASE risk_tier WHEN 'D' THEN 0 WHEN 'C' THEN 1 ELSE 2 END, entity_id LIMIT 50")
def _(s, d):
    return base.entities(s, d).orderBy(F.when(c("risk_tier") == "D", 0).when(c("risk_tier") == "C", 1).otherwise(2), "entity_id").limit(50).select("entity_id")


@add("S-LIMIT", "SELECT fact_id, (SELECT count(*) > 200 FROM assertions) AS truncated FROM (SELECT fact_id FROM assertions ORDER BY fact_id LIMIT 200)")
def _(s, d, n=200):
    """One page of n rows; truncated tells whether there are more."""
    page = facts(s, d).select("fact_id").orderBy("fact_id").limit(n + 1)
    w = W.partitionBy()
    return page.select("fact_id", (F.count("*").over(w) > n).alias("truncated"), F.row_number().over(W.orderBy("fact_id")).alias("r")).filter(c("r") <= n).drop("r")


@add("S-TOPK-BUDGET", "SELECT fact_id FROM (SELECT fact_id, row_number() OVER (PARTITION BY subject_type ORDER BY confidence DESC NULLS LAST, fact_id) AS r, count(*) OVER (PARTITION BY subject_type) AS n FROM assertions) WHERE r <= floor(0.1 * n + 0.5)")
def _(s, d):
    rows = running(facts(s, d).select("subject_type", "fact_id", "confidence"), ["subject_type"], [F.desc_nulls_last("confidence"), c("fact_id")], totals=True)
    return rows.filter(c("__place") <= F.floor(0.1 * c("__n") + 0.5)).select("fact_id")


# 2.7 set operations
@add("U-ALL", "SELECT fact_id, 'subject' AS endpoint, subject_id AS event_id FROM assertions WHERE subject_type = 'Event' UNION ALL SELECT fact_id, 'object', object_id FROM assertions WHERE object_type = 'Event'")
def _(s, d):
    """Facts unpivoted to their event endpoints, in one scan."""
    ends = F.array(F.struct(F.lit("subject").alias("endpoint"), c("subject_id").alias("event_id"), c("subject_type").alias("t")), F.struct(F.lit("object").alias("endpoint"), c("object_id").alias("event_id"), c("object_type").alias("t")))
    return facts(s, d).select("fact_id", F.inline(ends)).filter("t = 'Event'").drop("t")


QUERIES["D27"], SQL["D27"] = QUERIES["U-ALL"], SQL["U-ALL"]


@add("U-DISTINCT", "SELECT subject_id AS id FROM assertions WHERE subject_id IS NOT NULL UNION SELECT object_id FROM assertions WHERE object_id IS NOT NULL")
def _(s, d):
    return facts(s, d).select(F.explode(F.array("subject_id", "object_id")).alias("id")).dropna().distinct()


@add("U-INSERT-IGNORE", "SELECT state_id, fact_id, support_role FROM (SELECT *, row_number() OVER (PARTITION BY state_id, fact_id ORDER BY CASE support_role WHEN 'event_time' THEN 0 WHEN 'event_place' THEN 1 WHEN 'culture_relation' THEN 2 ELSE 3 END) AS r FROM state_support) WHERE r = 1")
def _(s, d):
    """The first writer of a key wins, by the order of its sources."""
    rank = F.array_position(F.array(*map(F.lit, ("event_time", "event_place", "culture_relation", "relation_context"))), c("support_role"))
    return base.state_support(s, d).groupBy("state_id", "fact_id").agg(F.min_by("support_role", rank).alias("support_role"))


QUERIES["D38"], SQL["D38"] = QUERIES["U-INSERT-IGNORE"], SQL["U-INSERT-IGNORE"]


@add("U-UPSERT", "SELECT e.entity_id, coalesce(n.n, e.member_count) AS member_count FROM entities e LEFT JOIN (SELECT subject_id, count(*) AS n FROM assertions GROUP BY 1) n ON n.subject_id = e.entity_id")
def _(s, d):
    n = by(facts(s, d), c("subject_id").alias("entity_id"))
    return base.entities(s, d).select("entity_id", "member_count").join(n, "entity_id", "left").select("entity_id", F.coalesce("n", "member_count").alias("member_count"))


@add("U-MEMBERSHIP", "SELECT (SELECT count(*) FROM (SELECT fact_id FROM assertions INTERSECT SELECT fact_id FROM v2_assertion_scopes)) AS in_both, (SELECT count(*) FROM (SELECT fact_id FROM v2_assertion_scopes EXCEPT SELECT fact_id FROM assertions)) AS only_scopes")
def _(s, d):
    a = facts(s, d).select("fact_id", F.lit(1).alias("a"))
    v = table(s, d, "v2_assertion_scopes").select("fact_id", F.lit(1).alias("v")).distinct()
    return a.join(v, "fact_id", "full").agg(F.count(F.when(c("a").isNotNull() & c("v").isNotNull(), 1)).alias("in_both"), F.count(F.when(c("a").isNull(), 1)).alias("only_scopes"))


# 2.8 scalar functions
@add("F-STR", "SELECT entity_id, substr(canonical_name, 1, 3) AS head, length(trim(canonical_name)) AS n, entity_id || chr(31) || canonical_name AS joined FROM entities")
def _(s, d):
    return base.entities(s, d).select("entity_id", F.substring("canonical_name", 1, 3).alias("head"), F.length(F.trim("canonical_name")).alias("n"), F.concat("entity_id", F.lit("\x1f"), "canonical_name").alias("joined"))


@add("F-STR-NORM", r"SELECT entity_id, lower(regexp_replace(canonical_name, '[\s·・‧]+', '', 'g')) AS tight FROM entities WHERE canonical_name IS NOT NULL")
def _(s, d):
    return base.entities(s, d).filter(c("canonical_name").isNotNull()).select("entity_id", X.tight(c("canonical_name")).alias("tight"))


@add("F-STR-SUFFIX", "SELECT entity_id, CASE WHEN length(canonical_name) > 2 AND ends_with(canonical_name, '会馆') THEN left(canonical_name, -2) WHEN length(canonical_name) > 2 AND ends_with(canonical_name, '码头') THEN left(canonical_name, -2) ELSE canonical_name END AS stem FROM entities WHERE source_entity_type = 'Place'")
def _(s, d):
    return base.entities(s, d).filter("source_entity_type = 'Place'").select("entity_id", X.strip_suffix(c("canonical_name"), ["会馆", "码头"]).alias("stem"))


@add("F-STR-POS", "SELECT fact_id, instr(lower(subject_name || ' ' || object_name), lower(object_name)) AS at, abs(length(subject_name) - length(object_name)) AS gap FROM assertions")
def _(s, d):
    both = F.lower(F.concat_ws(" ", "subject_name", "object_name"))
    at = F.when(c("subject_name").isNotNull(), F.call_function("instr", both, F.lower("object_name")))
    return facts(s, d).select("fact_id", at.alias("at"), F.abs(F.length("subject_name") - F.length("object_name")).alias("gap"))


# each sign of a pair of names becomes one of its own bytes, as the oracle's distance counts bytes
_SIGNS = "(SELECT fact_id, subject_name AS x, object_name AS y, regexp_extract_all(subject_name, '(?s).') AS a, regexp_extract_all(object_name, '(?s).') AS b FROM assertions)"
_CODED = "array_to_string(list_transform({0}, lambda v: chr((33 + list_position(list_distinct(a || b), v))::INTEGER)), '')"


@add("F-LEVENSHTEIN", f"SELECT fact_id, CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE least(levenshtein({_CODED.format('a')}, {_CODED.format('b')}), 4) END AS distance FROM {_SIGNS}")
def _(s, d):
    return facts(s, d).select("fact_id", X.bounded_levenshtein(c("subject_name"), c("object_name")).cast("long").alias("distance"))


@add("F-REGEX-EXTRACT", r"SELECT doc_id, regexp_extract(text, '(19\d{2})年', 1) AS first_year, len(regexp_extract_all(text, '19\d{2}')) AS n_years FROM documents WHERE text IS NOT NULL")
def _(s, d):
    t = table(s, d, "documents").filter("text is not null")
    return t.select("doc_id", F.regexp_extract("text", r"(19\d{2})年", 1).alias("first_year"), F.size(F.regexp_extract_all("text", F.lit(r"19\d{2}"), F.lit(0))).cast("long").alias("n_years"))


@add("F-REGEX-TYPE", "SELECT entity_id, CASE WHEN regexp_matches(canonical_name, '^《.*》') THEN 'CreativeWork' WHEN regexp_matches(canonical_name, '(游击支队|妇女救护会|剧社|报社)$') THEN 'Organization' WHEN regexp_matches(canonical_name, '(会馆|码头|石桥|祠堂|山口)$') THEN 'Place' WHEN contains(canonical_name, '·') THEN 'Person' ELSE 'Other' END AS hint FROM entities")
def _(s, d):
    n = c("canonical_name")
    hint = F.when(n.rlike("^《.*》"), "CreativeWork").when(n.rlike("(游击支队|妇女救护会|剧社|报社)$"), "Organization").when(n.rlike("(会馆|码头|石桥|祠堂|山口)$"), "Place").when(n.contains("·"), "Person").otherwise("Other")
    return base.entities(s, d).select("entity_id", hint.alias("hint"))


@add("F-DATE-SLICE", "SELECT fact_id, substr(time_start, 1, 4) AS y, substr(time_start, 6, 2) AS m FROM assertions")
def _(s, d):
    return facts(s, d).select("fact_id", F.substring("time_start", 1, 4).alias("y"), F.substring("time_start", 6, 2).alias("m"))


@add("F-DATE-PARSE", "SELECT fact_id, start_date, end_date FROM assertions")
def _(s, d):
    return facts(s, d).select("fact_id", "start_date", "end_date")


@add("F-DATE-LABEL", "SELECT fact_id, CASE time_precision WHEN 'year' THEN strftime(start_date, '%Y年') WHEN 'month' THEN strftime(start_date, '%Y年%m月') ELSE strftime(start_date, '%Y-%m-%d') || '—' || strftime(end_date, '%Y-%m-%d') END AS label FROM assertions")
def _(s, d):
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    label = F.when(c("time_precision") == "year", F.date_format("start_date", "yyyy年")).when(c("time_precision") == "month", F.date_format("start_date", "yyyy年MM月")).otherwise(F.concat(day("start_date"), F.lit("—"), day("end_date")))
    return facts(s, d).select("fact_id", label.alias("label"))


@add("F-MATH", "SELECT fact_id, round(confidence + 1e-9, 2) AS r, greatest(confidence, 0.5) AS g, round(1 + ln(1 + source_member_count), 6) AS w, round(CASE WHEN confidence <= 0 OR confidence >= 1 THEN 0 ELSE -confidence * log2(confidence) - (1 - confidence) * log2(1 - confidence) END, 6) AS h FROM assertions WHERE confidence IS NOT NULL")
def _(s, d):
    f = facts(s, d).filter("confidence is not null")
    return f.select("fact_id", F.round(c("confidence") + 1e-9, 2).alias("r"), F.greatest("confidence", F.lit(0.5)).alias("g"), F.round(1 + F.log1p(c("source_member_count")), 6).alias("w"), F.round(X.entropy(c("confidence")), 6).alias("h"))


@add("F-JSON", "SELECT event_id, (props->>'k')::BIGINT AS k, json_valid(props) AS ok FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.from_json("props", "map<string,string>").isNotNull().alias("ok"))


@add("F-JSON-CANON", """SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS doc FROM nation""")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", F.to_json(F.struct(c("n_name").alias("name"), c("n_regionkey").alias("region"))).alias("doc"))


@add("F-JSON-LENIENT", "SELECT entity_id, len(CASE WHEN starts_with(aliases_json, '[') THEN from_json(aliases_json, '[\"VARCHAR\"]') ELSE regexp_split_to_array(aliases_json, '[,;、]') END) AS n FROM entities WHERE aliases_json IS NOT NULL")
def _(s, d):
    """A JSON list, or else a list split at separators."""
    listed = F.when(c("aliases_json").startswith("["), F.from_json("aliases_json", "array<string>")).otherwise(F.split("aliases_json", "[,;、]"))
    return base.entities(s, d).filter("aliases_json is not null").select("entity_id", F.size(listed).cast("long").alias("n"))


@add("F-ARRAY", "SELECT event_id, len(list_distinct(list(predicate))) AS n, list_sort(list_distinct(list(predicate)))[1] AS first FROM links GROUP BY 1")
def _(s, d):
    p = F.array_sort(F.array_distinct(F.collect_list("predicate")))
    return base.links(s, d).groupBy("event_id").agg(F.size(p).cast("long").alias("n"), F.try_element_at(p, F.lit(1)).alias("first"))


@add("F-HASH-ID", "SELECT fact_id, 'K-' || substr(sha256(concat_ws(chr(31), subject_id, predicate, object_id)), 1, 24) AS id, 'N-' || substr(sha256(concat_ws(chr(31), coalesce(province, ''), predicate)), 1, 24) AS id_nulls FROM assertions")
def _(s, d):
    return facts(s, d).select("fact_id", X.stable_id("K", "subject_id", "predicate", "object_id").alias("id"), X.stable_id_nulls("N", c("province"), c("predicate")).alias("id_nulls"))


@add("F-HASH-UNIFORM", "SELECT fact_id, ('0x' || substr(sha256(fact_id), 1, 12))::BIGINT / 281474976710656.0 AS u, ('0x' || substr(sha256(fact_id), 1, 12))::BIGINT % 5 AS split FROM assertions")
def _(s, d):
    return facts(s, d).select("fact_id", X.hash_uniform("fact_id").alias("u"), X.hash_split(5, "fact_id").alias("split"))


@add("D82", "SELECT task_id, CASE WHEN ('0x' || substr(sha256('seed::' || task_id), 1, 2))::BIGINT % 2 = 0 THEN 'AB' ELSE 'BA' END AS presented FROM (SELECT DISTINCT task_id FROM closure3_old_new_heldout WHERE task_id IS NOT NULL)")
def _(s, d):
    return table(s, d, "closure3_old_new_heldout").select("task_id").dropna().distinct().select("task_id", X.ab_order("seed", c("task_id")).alias("presented"))


@add("F-BIN", "SELECT fact_id, CASE WHEN confidence IS NULL THEN NULL WHEN confidence <= 0.5 THEN 'low' WHEN confidence <= 0.8 THEN 'mid' ELSE 'high' END AS bin FROM assertions")
def _(s, d):
    return facts(s, d).select("fact_id", X.bin_of(c("confidence"), [0.5, 0.8], ["low", "mid", "high"]).alias("bin"))


_DIGEST = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))


@add("SNK-DIGEST", f"SELECT sha256(concat_ws('|', count(*)::VARCHAR, {_DIGEST})) AS digest FROM (SELECT sha256(concat_ws(chr(31), fact_id, subject_id, predicate, object_id, merged_into)) AS h FROM assertions)")
def _(s, d):
    """One digest of all facts' keys, whatever the order of the rows."""
    h = F.sha2(F.concat_ws("\x1f", "fact_id", "subject_id", "predicate", "object_id", "merged_into"), 256)
    return digest_of(facts(s, d).select(h.alias("digest")))
