"""The research base, event and state layers over the domain tables, once as DataFrames and once as SQL.

Every frame is keyed: repeated rows are settled here (the latest ingested row wins, ties by content), so that what
builds on it needs no distinct. Stage bounds are parameters, as the tables carry stage codes but no dates.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import stable_id
from factloom.operators.intervals import partial_date
from factloom.session import stored, table

# Bounds of the eight stages by order, and the years of the basin's review.
STAGE_BOUNDS = [
    (1, "1900-01-01", "1918-12-31"), (2, "1919-01-01", "1926-12-31"), (3, "1927-01-01", "1933-12-31"), (4, "1934-01-01", "1937-06-30"),
    (5, "1937-07-01", "1945-08-31"), (6, "1945-09-01", "1949-09-30"), (7, "1949-10-01", "1966-12-31"), (8, "1967-01-01", "1999-12-31"),
]
TRUSTED_TIME = ("model_adjudicated", "source_consensus")
TIERS = {3: "trusted_event_spacetime", 2: "asserted_event_spacetime", 1: "relation_context"}


def latest(df: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    """W-LATEST: the row of each key that was ingested last; of equal ones the greatest in ties. Null keys are left out."""
    order = [F.col(c).desc_nulls_last() for c in ("ingested_at", *ties)]
    rows = df.filter(" and ".join(f"{k} is not null" for k in keys))
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def layer(*sources: str) -> Callable:
    """A frame that is built once per application and then read back: the base, event and state layers."""

    def keep(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(build)
        def read(spark: SparkSession, sf: str) -> DataFrame:
            return stored(spark, sf, build.__name__, sources, lambda: build(spark, sf))

        return read

    return keep


@layer("research_assertions")
def assertions(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest(table(spark, sf, "research_assertions"), ["fact_id"], "merged_into", "merge_rule", "confidence")
    return rows.withColumns({"start_date": partial_date(F.col("time_start"), False), "end_date": partial_date(F.col("time_end"), True)})


@layer("v2_entities")
def entities(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "v2_entities"), ["entity_id"], "updated_at", "canonical_name")


@layer("research_culture_states")
def states(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "research_culture_states"), ["state_id"], "supporting_fact_count")


LINK_COLUMNS = ["event_id", "event_name", "fact_id", "event_endpoint", "counterpart_id", "counterpart_name", "counterpart_type", "predicate", "semantic_route", "occurrence_time_start", "occurrence_time_end", "occurrence_time_status"]


@layer("research_event_assertion_links")
def links(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["event_id", "fact_id", "event_endpoint"]
    return latest(table(spark, sf, "research_event_assertion_links"), keys, *(c for c in LINK_COLUMNS if c not in keys)).select(LINK_COLUMNS)


@layer("research_culture_state_support")
def state_support(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "research_culture_state_support").select("state_id", "fact_id", "support_role").dropna().distinct()


@layer("research_event_cell_support")
def cell_support(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "research_event_cell_support").select("cell_id", "fact_id", "support_role").dropna().distinct()


def stages(spark: SparkSession, sf: str) -> DataFrame:
    """The stages with code, label and bounds; eight rows."""
    bounds = spark.createDataFrame([(o, a, b) for o, a, b in STAGE_BOUNDS], "stage_order int, stage_start string, stage_end string")
    named = table(spark, sf, "research_culture_states").groupBy("stage_order").agg(F.min("stage_code").alias("stage_code"), F.min("stage_label_zh").alias("stage_label_zh"))
    dated = bounds.withColumns({"stage_start": F.to_date("stage_start"), "stage_end": F.to_date("stage_end")})
    return named.join(F.broadcast(dated), "stage_order")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """The study regions with their province; their number is that of the provinces, whatever the data's size."""
    return table(spark, sf, "research_culture_states").filter("region_id is not null").groupBy("region_id").agg(F.min("province_name").alias("province_name"))


@layer("research_assertions")
def stage_memberships(spark: SparkSession, sf: str) -> DataFrame:
    """J-INTERVAL-OVERLAP: facts in the stages that their interval meets, with the shared days.

    The eight stages become one array on every row, so that the overlap needs no nested-loop join and no shuffle.
    """
    bounds = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for o, a, b in STAGE_BOUNDS])
    facts = assertions(spark, sf).filter("start_date <= end_date").select("fact_id", "start_date", "end_date", F.explode(bounds).alias("s"))
    met = facts.filter((F.col("start_date") <= F.col("s.b")) & (F.col("end_date") >= F.col("s.a")))
    return met.select("fact_id", F.col("s.o").alias("stage_order"), F.greatest("start_date", "s.a").alias("overlap_start"), F.least("end_date", "s.b").alias("overlap_end"))


def fact_regions(spark: SparkSession, sf: str) -> DataFrame:
    facts = assertions(spark, sf).filter("province is not null").select("fact_id", F.col("province").alias("province_name"))
    return facts.join(regions(spark, sf), "province_name").select("fact_id", "region_id")


@layer("research_assertions", "research_event_assertion_links")
def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event from its links: time and place evidence, trusted times, roles."""
    facts = assertions(spark, sf).select("fact_id", "province", "space_role")
    joined = links(spark, sf).join(facts, "fact_id", "left")
    timed, strict = F.col("occurrence_time_start").isNotNull(), F.col("semantic_route") == "strict_controlled"
    trusted = F.col("occurrence_time_status").isin(*TRUSTED_TIME)
    n = lambda c: F.countDistinct(F.when(c, F.col("fact_id")))
    rank = F.max(F.when(timed & trusted, 2).when(timed, 1).otherwise(0))
    return joined.groupBy("event_id").agg(
        F.min("event_name").alias("event_name"), n(timed).alias("occurrence_time_fact_count"), n(timed & trusted).alias("trusted_time_fact_count"),
        n(F.col("space_role") == "event_location").alias("event_location_fact_count"), n(strict).alias("controlled_role_count"),
        F.min(F.when(timed, F.col("occurrence_time_start"))).alias("observed_start"), F.max(F.when(timed, F.col("occurrence_time_end"))).alias("observed_end"),
        F.element_at(F.array(F.lit("none"), F.lit("asserted_candidate"), F.lit("trusted")), rank + 1).alias("observed_time_status"),
        F.when(n(timed) == 0, "no_time").when(n(F.col("province").isNotNull()) == 0, "no_place").otherwise("complete").alias("frame_status"),
    )


ROLES = {"participated_in": "participant", "led": "leader", "member_of": "member", "stationed_at": "station", "located_in": "place", "occurred_at": "place", "trained": "trainee", "commemorates": "commemoration", "published_by": "publisher"}


def roles(spark: SparkSession, sf: str) -> DataFrame:
    """Controlled roles of an event's counterparts, from strict links and the role catalogue (a fixed small map)."""
    catalogue = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    strict = links(spark, sf).filter(F.col("semantic_route") == "strict_controlled")
    return strict.withColumn("role_code", catalogue[F.col("predicate")]).filter("role_code is not null").select(
        "event_id", "fact_id", "role_code", "counterpart_id", "counterpart_name", "counterpart_type"
    )


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    facts = assertions(spark, sf).select("fact_id", "province", "start_date", "end_date")
    at = links(spark, sf).join(facts, "fact_id").join(regions(spark, sf).withColumnRenamed("province_name", "province"), "province", "left")
    day = F.coalesce(partial_date(F.col("occurrence_time_start"), False), F.col("start_date"))
    order = F.coalesce(*[F.when(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(o)) for o, a, b in STAGE_BOUNDS])
    rank = F.when(F.col("occurrence_time_status").isin(*TRUSTED_TIME), 3).when(F.col("occurrence_time_start").isNotNull(), 2).otherwise(1)
    return at.select("event_id", "event_name", "fact_id", "semantic_route", "region_id", order.alias("stage_order"), rank.alias("rank"))


@layer("research_assertions", "research_event_assertion_links", "research_culture_states")
def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of event, stage and region: dated facts of an event met with its placed facts (explicit), and strict
    facts that have both (context). Dates and places are made distinct per event before they meet."""
    e = _evidence(spark, sf)
    dated = e.filter("rank >= 2 and stage_order is not null").groupBy("event_id", "stage_order").agg(F.max("rank").alias("rank"), F.count("*").alias("time_facts"))
    placed = e.filter("region_id is not null").groupBy("event_id", "region_id").agg(F.count("*").alias("place_facts"))
    explicit = dated.join(placed, "event_id").select("event_id", "stage_order", "region_id", "rank", "time_facts", "place_facts", F.lit(0).cast("long").alias("context_facts"))
    none = F.lit(0).cast("long")
    context = (
        e.filter("semantic_route = 'strict_controlled' and region_id is not null and stage_order is not null")
        .groupBy("event_id", "stage_order", "region_id")
        .agg(F.count("*").alias("context_facts"))
        .select("event_id", "stage_order", "region_id", F.lit(1).alias("rank"), none.alias("time_facts"), none.alias("place_facts"), "context_facts")
    )
    merged = explicit.unionByName(context).groupBy("event_id", "stage_order", "region_id").agg(
        F.max("rank").alias("rank"), F.max("time_facts").alias("time_facts"), F.max("place_facts").alias("place_facts"), F.max("context_facts").alias("context_facts")
    )
    name = links(spark, sf).groupBy("event_id").agg(F.min("event_name").alias("event_name"))
    tier = F.element_at(F.array(*[F.lit(TIERS[k]) for k in (1, 2, 3)]), F.col("rank"))
    dims = merged.join(stages(spark, sf).select("stage_order", "stage_code", "stage_label_zh"), "stage_order").join(regions(spark, sf), "region_id")
    return dims.join(name, "event_id").select(
        stable_id("CELL", "event_id", "stage_code", "region_id").alias("cell_id"), "event_id", "event_name", "stage_order", "stage_code", "stage_label_zh",
        "region_id", "province_name", tier.alias("observation_tier"), "time_facts", "place_facts", "context_facts",
    )


RULES = {"influenced": ("transformed_into", 0.9), "commemorates": ("memorialized_as", 0.85), "led": ("institutionalized_as", 0.8), "published_by": ("adapted_as", 0.75), "part_of": ("absorbed_into", 0.7), "trained": ("spread_to", 0.65)}


def _rules(column: str) -> list[Column]:
    kind = F.create_map(*[F.lit(x) for k, (t, _) in RULES.items() for x in (k, t)])
    sure = F.create_map(*[F.lit(x) for k, (_, c) in RULES.items() for x in (k, c)])
    return [kind[F.col(column)].alias("transition_type"), sure[F.col(column)].alias("confidence")]


def publication_gate(candidates: DataFrame, regions_of: DataFrame, stages_of: DataFrame) -> DataFrame:
    """Candidates with publication_gate_reason. A direct candidate of two trusted states is published if it is the only
    one of its fact that lies in a region and a stage which the fact itself names, where it names any.

    candidates: fact_id, rule_kind, from_region_id, from_stage_order, and both observation tiers; regions_of: fact_id,
    region_id; stages_of: fact_id, stage_order. Facts are counted by an aggregate that combines before the shuffle.
    """
    regions_of, stages_of = regions_of.select("fact_id", "region_id").distinct(), stages_of.select("fact_id", "stage_order").distinct()
    names = lambda df, flag: df.select("fact_id").distinct().withColumn(flag, F.lit(True))
    at = candidates.join(names(regions_of, "has_region"), "fact_id", "left").join(names(stages_of, "has_stage"), "fact_id", "left")
    at = at.join(regions_of.select("fact_id", F.col("region_id").alias("from_region_id"), F.lit(True).alias("in_region")), ["fact_id", "from_region_id"], "left")
    at = at.join(stages_of.select("fact_id", F.col("stage_order").alias("from_stage_order"), F.lit(True).alias("in_stage")), ["fact_id", "from_stage_order"], "left")
    trusted = F.col("from_observation_tier").eqNullSafe("trusted_event_spacetime") & F.col("to_observation_tier").eqNullSafe("trusted_event_spacetime")
    fits = (F.col("has_region").isNull() | F.col("in_region").isNotNull()) & (F.col("has_stage").isNull() | F.col("in_stage").isNotNull())
    at = at.withColumn("ok", (F.col("rule_kind") == "direct") & trusted & fits)
    alone = at.filter("ok").groupBy("fact_id").agg(F.count("*").alias("n")).filter("n = 1").select("fact_id", F.lit(True).alias("alone"))
    named = F.col("has_region").isNotNull() | F.col("has_stage").isNotNull()
    chosen = F.when(named, "unique_explicit_spatiotemporal_match").otherwise("unique_trusted_state_pair")
    reason = F.when(F.col("rule_kind") == "spatial", "spatial_review_required").when(~trusted, "nontrusted_state").when(F.col("ok") & F.col("alone"), chosen).otherwise("ambiguous_spatiotemporal_expansion")
    return at.join(alone, "fact_id", "left").select(*candidates.columns, reason.alias("publication_gate_reason"))


@layer("research_assertions", "research_culture_states", "research_culture_state_support")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Transition candidates from shared supporting facts, with their publication gate.

    direct: both states rest on the fact, in one stage and region. spatial: same subject and form, later stage, other
    region, the fact supports the later state. See publication_gate for what is published.
    """
    s = states(spark, sf).select("state_id", "culture_subject_id", "culture_form_code", "stage_order", "region_id", "observation_tier")
    sup = state_support(spark, sf).select("state_id", "fact_id").distinct()
    ruled = assertions(spark, sf).select("fact_id", *_rules("predicate")).filter("transition_type is not null")
    on = sup.join(ruled, "fact_id").join(s, "state_id")
    side = lambda p: on.select("fact_id", *(F.col(c).alias(f"{p}_{c}") for c in ("state_id", "stage_order", "region_id", "observation_tier")))
    x = side("to").join(ruled, "fact_id")
    direct = side("from").join(x, "fact_id").filter("from_stage_order = to_stage_order and from_region_id = to_region_id and from_state_id < to_state_id")
    keep = ["transition_type", "confidence", "from_state_id", "to_state_id", "fact_id", "from_observation_tier", "to_observation_tier", "from_stage_order", "from_region_id"]
    spread = on.filter("transition_type = 'spread_to'")
    later = spread.select("fact_id", "transition_type", "confidence", "culture_subject_id", "culture_form_code", *(F.col(c).alias(f"to_{c}") for c in ("state_id", "stage_order", "region_id", "observation_tier")))
    early = s.select("culture_subject_id", "culture_form_code", *(F.col(c).alias(f"from_{c}") for c in ("state_id", "stage_order", "region_id", "observation_tier")))
    spatial = early.join(later, ["culture_subject_id", "culture_form_code"]).filter("from_stage_order < to_stage_order and from_region_id <> to_region_id")
    both = direct.select(*keep, F.lit("direct").alias("rule_kind")).unionByName(spatial.select(*keep, F.lit("spatial").alias("rule_kind")))
    gated = publication_gate(both, fact_regions(spark, sf), stage_memberships(spark, sf))
    return gated.select(
        stable_id("CAND", "transition_type", "from_state_id", "to_state_id", "fact_id").alias("candidate_id"), "transition_type", "confidence", "rule_kind",
        "from_state_id", "to_state_id", F.col("fact_id").alias("supporting_fact_id"), "publication_gate_reason",
        F.col("publication_gate_reason").startswith("unique_").cast("int").alias("publication_eligible"),
    )


def transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Published transitions: eligible candidates by type and states."""
    return candidates(spark, sf).filter("publication_eligible = 1").groupBy("transition_type", "from_state_id", "to_state_id").agg(
        F.max("confidence").alias("confidence"), F.countDistinct("supporting_fact_id").alias("supporting_fact_count")
    ).select(stable_id("TRANS", "transition_type", "from_state_id", "to_state_id").alias("transition_id"), "*")


# --- the same in SQL --------------------------------------------------------------------------------------------------


def _date(col: str, end: bool) -> str:
    s = f"rtrim(replace(translate(trim({col}, chr(32) || chr(9) || chr(160) || chr(12288)), '０１２３４５６７８９年月/.', '0123456789----'), '日', ''), '-')"
    year = f"try_cast({s} || '-{'12-31' if end else '01-01'}' AS DATE)"
    month = f"last_day(try_cast({s} || '-01' AS DATE))" if end else f"try_cast({s} || '-01' AS DATE)"
    return rf"CASE WHEN regexp_full_match({s}, '\d{{4}}') THEN {year} WHEN regexp_full_match({s}, '\d{{4}}-\d{{1,2}}') THEN {month} WHEN regexp_full_match({s}, '\d{{4}}-\d{{1,2}}-\d{{1,2}}( \d{{1,2}}:\d{{2}}(:\d{{2}})?)?') THEN try_cast(split_part({s}, ' ', 1) AS DATE) END"


def _latest(name: str, keys: str, ties: str, cols: str = "*") -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ["ingested_at", *ties.split()])
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {name} WHERE {known}) WHERE rn = 1"


_BOUNDS = ", ".join(f"({o}, DATE '{a}', DATE '{b}')" for o, a, b in STAGE_BOUNDS)
_LINK_TIES = " ".join(c for c in LINK_COLUMNS if c not in ("event_id", "fact_id", "event_endpoint"))
_RULES_SQL = ", ".join(f"('{k}', '{t}', {c}::DOUBLE)" for k, (t, c) in RULES.items())
CTES = {
    "assertions": f"SELECT *, {_date('time_start', False)} AS start_date, {_date('time_end', True)} AS end_date FROM ({_latest('research_assertions', 'fact_id', 'merged_into merge_rule confidence')})",
    "entities": _latest("v2_entities", "entity_id", "updated_at canonical_name"),
    "states": _latest("research_culture_states", "state_id", "supporting_fact_count"),
    "links": _latest("research_event_assertion_links", "event_id, fact_id, event_endpoint", _LINK_TIES, ", ".join(LINK_COLUMNS)),
    "state_support": "SELECT DISTINCT state_id, fact_id, support_role FROM research_culture_state_support WHERE state_id IS NOT NULL AND fact_id IS NOT NULL AND support_role IS NOT NULL",
    "cell_support": "SELECT DISTINCT cell_id, fact_id, support_role FROM research_event_cell_support WHERE cell_id IS NOT NULL AND fact_id IS NOT NULL AND support_role IS NOT NULL",
    "stages": f"SELECT b.stage_order, stage_code, stage_label_zh, stage_start, stage_end FROM (VALUES {_BOUNDS}) b(stage_order, stage_start, stage_end) JOIN (SELECT stage_order, min(stage_code) AS stage_code, min(stage_label_zh) AS stage_label_zh FROM research_culture_states GROUP BY 1) n ON n.stage_order = b.stage_order",
    "regions": "SELECT region_id, min(province_name) AS province_name FROM research_culture_states WHERE region_id IS NOT NULL GROUP BY 1",
    "stage_memberships": f"SELECT fact_id, o AS stage_order, greatest(start_date, sa) AS overlap_start, least(end_date, sb) AS overlap_end FROM assertions, (VALUES {_BOUNDS}) b(o, sa, sb) WHERE start_date <= end_date AND start_date <= sb AND end_date >= sa",
    "fact_regions": "SELECT fact_id, region_id FROM assertions JOIN regions ON province = province_name",
    "frames": """SELECT event_id, min(event_name) AS event_name, count(DISTINCT fact_id) FILTER (timed) AS occurrence_time_fact_count, count(DISTINCT fact_id) FILTER (timed AND trusted) AS trusted_time_fact_count,
  count(DISTINCT fact_id) FILTER (space_role = 'event_location') AS event_location_fact_count, count(DISTINCT fact_id) FILTER (semantic_route = 'strict_controlled') AS controlled_role_count,
  min(occurrence_time_start) AS observed_start, max(occurrence_time_end) FILTER (timed) AS observed_end,
  CASE WHEN count(*) FILTER (timed AND trusted) > 0 THEN 'trusted' WHEN count(*) FILTER (timed) > 0 THEN 'asserted_candidate' ELSE 'none' END AS observed_time_status,
  CASE WHEN count(*) FILTER (timed) = 0 THEN 'no_time' WHEN count(*) FILTER (province IS NOT NULL) = 0 THEN 'no_place' ELSE 'complete' END AS frame_status
FROM (SELECT l.*, a.province, a.space_role, occurrence_time_start IS NOT NULL AS timed, coalesce(occurrence_time_status IN ('model_adjudicated', 'source_consensus'), false) AS trusted FROM links l LEFT JOIN assertions a ON a.fact_id = l.fact_id) GROUP BY 1""",
    "roles": "SELECT event_id, fact_id, role_code, counterpart_id, counterpart_name, counterpart_type FROM links JOIN (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in ROLES.items())
    + ") c(p, role_code) ON predicate = p WHERE semantic_route = 'strict_controlled'",
    "evidence": f"""SELECT l.event_id, l.fact_id, l.semantic_route, region_id, b.o AS stage_order,
  CASE WHEN occurrence_time_status IN ('model_adjudicated', 'source_consensus') THEN 3 WHEN occurrence_time_start IS NOT NULL THEN 2 ELSE 1 END AS rank
FROM links l JOIN assertions a ON a.fact_id = l.fact_id LEFT JOIN regions r ON r.province_name = a.province
LEFT JOIN (VALUES {_BOUNDS}) b(o, sa, sb) ON coalesce({_date('occurrence_time_start', False)}, start_date) BETWEEN sa AND sb""",
    "cells": """SELECT 'CELL-' || substr(sha256(concat_ws(chr(31), m.event_id, stage_code, m.region_id)), 1, 24) AS cell_id, m.event_id, event_name, m.stage_order, stage_code, stage_label_zh, m.region_id, province_name,
  CASE rank WHEN 3 THEN 'trusted_event_spacetime' WHEN 2 THEN 'asserted_event_spacetime' ELSE 'relation_context' END AS observation_tier, time_facts, place_facts, context_facts
FROM (SELECT event_id, stage_order, region_id, max(rank) AS rank, max(tf) AS time_facts, max(pf) AS place_facts, max(cf) AS context_facts FROM (
  SELECT d.event_id, d.stage_order, p.region_id, d.rank, tf, pf, 0 AS cf FROM (SELECT event_id, stage_order, max(rank) AS rank, count(*) AS tf FROM evidence WHERE rank >= 2 AND stage_order IS NOT NULL GROUP BY 1, 2) d
  JOIN (SELECT event_id, region_id, count(*) AS pf FROM evidence WHERE region_id IS NOT NULL GROUP BY 1, 2) p ON p.event_id = d.event_id
  UNION ALL SELECT event_id, stage_order, region_id, 1, 0, 0, count(*) FROM evidence WHERE semantic_route = 'strict_controlled' AND region_id IS NOT NULL AND stage_order IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2, 3) m
JOIN stages s ON s.stage_order = m.stage_order JOIN regions r ON r.region_id = m.region_id JOIN frames f ON f.event_id = m.event_id""",
    "ruled": f"SELECT fact_id, t AS transition_type, c AS confidence FROM assertions JOIN (VALUES {_RULES_SQL}) r(p, t, c) ON predicate = p",
    "supported": "SELECT DISTINCT r.fact_id, r.transition_type, r.confidence, s.state_id, s.culture_subject_id, s.culture_form_code, s.stage_order, s.region_id, s.observation_tier FROM state_support u JOIN ruled r ON r.fact_id = u.fact_id JOIN states s ON s.state_id = u.state_id",
    "proposed": """SELECT a.transition_type, a.confidence, a.state_id AS from_state_id, b.state_id AS to_state_id, a.fact_id, a.observation_tier AS ft, b.observation_tier AS tt, 'direct' AS rule_kind, a.stage_order AS fs, a.region_id AS fr
  FROM supported a JOIN supported b ON a.fact_id = b.fact_id AND a.stage_order = b.stage_order AND a.region_id = b.region_id AND a.state_id < b.state_id
  UNION ALL SELECT b.transition_type, b.confidence, a.state_id, b.state_id, b.fact_id, a.observation_tier, b.observation_tier, 'spatial', a.stage_order, a.region_id
  FROM states a JOIN supported b ON a.culture_subject_id = b.culture_subject_id AND a.culture_form_code = b.culture_form_code AND a.stage_order < b.stage_order AND a.region_id <> b.region_id WHERE b.transition_type = 'spread_to'""",
    "gated": """SELECT p.*, coalesce(ft = 'trusted_event_spacetime' AND tt = 'trusted_event_spacetime', false) AS trusted, fact_id IN (SELECT fact_id FROM fact_regions) AS hr, fact_id IN (SELECT fact_id FROM stage_memberships) AS hs,
  (fact_id, fr) IN (SELECT (fact_id, region_id) FROM fact_regions) AS ir, (fact_id, fs) IN (SELECT (fact_id, stage_order) FROM stage_memberships) AS ins FROM proposed p""",
    "candidates": """SELECT 'CAND-' || substr(sha256(concat_ws(chr(31), transition_type, from_state_id, to_state_id, fact_id)), 1, 24) AS candidate_id, transition_type, confidence, rule_kind, from_state_id, to_state_id, fact_id AS supporting_fact_id, reason AS publication_gate_reason, starts_with(reason, 'unique_')::INTEGER AS publication_eligible
FROM (SELECT *, CASE WHEN rule_kind = 'spatial' THEN 'spatial_review_required' WHEN NOT trusted THEN 'nontrusted_state' WHEN ok AND count(*) FILTER (ok) OVER (PARTITION BY fact_id) = 1 THEN CASE WHEN hr OR hs THEN 'unique_explicit_spatiotemporal_match' ELSE 'unique_trusted_state_pair' END ELSE 'ambiguous_spatiotemporal_expansion' END AS reason
FROM (SELECT *, rule_kind = 'direct' AND trusted AND (NOT hr OR ir) AND (NOT hs OR ins) AS ok FROM gated))""",
    "transitions": "SELECT 'TRANS-' || substr(sha256(concat_ws(chr(31), transition_type, from_state_id, to_state_id)), 1, 24) AS transition_id, transition_type, from_state_id, to_state_id, max(confidence) AS confidence, count(DISTINCT supporting_fact_id) AS supporting_fact_count FROM candidates WHERE publication_eligible = 1 GROUP BY ALL",
}


def over(body: str) -> str:
    """SQL with the WITH clause of all frames that its text names, in order of definition."""
    wanted, text = set(), body
    for name in reversed(CTES):
        if re.search(rf"\b{name}\b", text):
            wanted.add(name)
            text += CTES[name]
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in wanted) + "\n" + body if wanted else body
