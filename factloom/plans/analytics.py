"""Domain, graph and evaluation queries (sections 2.9, 2.13 and 2.14) under their Ids, with SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import graph, stats
from factloom.operators.pairs import pairs_within
from factloom.operators.ranks import running
from factloom.plans import base
from factloom.plans.base import over
from factloom.session import cut, table

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


# The one type that the contract allows for an endpoint of a predicate, and types with their parents.
CONTRACT = [("led", "subject", "Person"), ("member_of", "object", "Organization"), ("trained", "subject", "Organization"), ("located_in", "object", "Place"), ("occurred_at", "subject", "Event"), ("published_by", "subject", "CreativeWork")]
_CON = ", ".join(map(repr, CONTRACT))
_VOTES = f"(SELECT id, vote, count(*) AS n FROM (SELECT subject_id AS id, t AS vote FROM assertions JOIN (VALUES {_CON}) k(p, e, t) ON p = predicate AND e = 'subject' UNION ALL SELECT object_id, t FROM assertions JOIN (VALUES {_CON}) k(p, e, t) ON p = predicate AND e = 'object') WHERE id IS NOT NULL GROUP BY 1, 2)"


def schema_votes(s, d) -> DataFrame:
    rules = F.create_map(*[x for p, e, t in CONTRACT for x in (F.lit(f"{p}/{e}"), F.lit(t))])
    ends = F.array(*[F.struct(c(f"{e}_id").alias("id"), rules[F.concat("predicate", F.lit(f"/{e}"))].alias("vote")) for e in ("subject", "object")])
    return facts(s, d).select(F.inline(ends)).dropna().groupBy("id", "vote").agg(F.count("*").alias("n"))


@add("D01", f"SELECT * FROM {_VOTES}")
def _(s, d):
    return schema_votes(s, d)


@add("D02", f"SELECT entity_id, CASE WHEN top >= 2 AND top - second >= 2 THEN vote ELSE coalesce(semantic_entity_type, source_entity_type) END AS fused, CASE WHEN top >= 2 AND top - second >= 2 THEN 'voted' WHEN semantic_entity_type IS NOT NULL THEN 'semantic' ELSE 'source' END AS status FROM entities LEFT JOIN (SELECT id, max(n) AS top, coalesce(max(CASE WHEN r = 2 THEN n END), 0) AS second, max(CASE WHEN r = 1 THEN vote END) AS vote FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, vote) AS r FROM {_VOTES}) GROUP BY 1) v ON v.id = entity_id")
def _(s, d):
    """Fuses source type, semantic type and votes; a vote decides with 2 votes and a lead of 2 at least."""
    ranked = F.array_sort(F.collect_list(F.struct((-c("n")).alias("n"), "vote")))
    v = schema_votes(s, d).groupBy(c("id").alias("entity_id")).agg(ranked.alias("v"))
    top, second = -F.get("v", F.lit(0))["n"], -F.coalesce(F.get("v", F.lit(1))["n"], F.lit(0))
    decisive = F.coalesce((top >= 2) & (top - second >= 2), F.lit(False))
    e = base.entities(s, d).select("entity_id", "semantic_entity_type", "source_entity_type").join(v, "entity_id", "left")
    return e.select("entity_id", F.when(decisive, F.get("v", F.lit(0))["vote"]).otherwise(F.coalesce("semantic_entity_type", "source_entity_type")).alias("fused"), F.when(decisive, "voted").when(c("semantic_entity_type").isNotNull(), "semantic").otherwise("source").alias("status"))


@add("D03", f"SELECT entity_id AS id, source_entity_type AS label, 'source' AS signal, 1.0::DOUBLE AS weight FROM entities WHERE source_entity_type IS NOT NULL UNION ALL SELECT entity_id, semantic_entity_type, 'semantic', 4.0 FROM entities WHERE semantic_entity_type IS NOT NULL UNION ALL SELECT id, vote, 'schema', round(least(4, 1 + ln(1 + n)), 6) FROM {_VOTES}")
def _(s, d):
    e = base.entities(s, d)
    sig = lambda t, name, w: e.filter(c(t).isNotNull()).select(c("entity_id").alias("id"), c(t).alias("label"), F.lit(name).alias("signal"), F.lit(w).alias("weight"))
    v = schema_votes(s, d).select("id", c("vote").alias("label"), F.lit("schema").alias("signal"), F.round(F.least(F.lit(4.0), 1 + F.log1p(c("n"))), 6).alias("weight"))
    return sig("source_entity_type", "source", 1.0).unionByName(sig("semantic_entity_type", "semantic", 4.0)).unionByName(v)


@add("D04", "SELECT fact_id, CASE WHEN predicate IN ('occurred_at', 'participated_in') THEN 'event_occurrence' WHEN predicate = 'published_by' THEN 'creation_or_publication' WHEN predicate = 'commemorates' THEN 'commemoration_or_reception' WHEN predicate LIKE 'raw:%' THEN 'context_time' ELSE 'relation_validity' END AS time_role, CASE WHEN (subject_type = 'Event') <> (object_type = 'Event') THEN CASE WHEN subject_type = 'Event' THEN subject_id ELSE object_id END END AS time_owner FROM assertions")
def _(s, d):
    """Time role by predicate, owner only where exactly one end is an event."""
    p, se, oe = c("predicate"), c("subject_type") == "Event", c("object_type") == "Event"
    role = F.when(p.isin("occurred_at", "participated_in"), "event_occurrence").when(p == "published_by", "creation_or_publication").when(p == "commemorates", "commemoration_or_reception").when(p.like("raw:%"), "context_time").otherwise("relation_validity")
    return facts(s, d).select("fact_id", role.alias("time_role"), F.when(se != oe, F.when(se, c("subject_id")).otherwise(c("object_id"))).alias("time_owner"))


@add("D05", "SELECT fact_id, CASE WHEN predicate = 'located_in' THEN 'relation_location' WHEN object_type = 'Place' AND subject_type = 'Event' THEN 'event_location' WHEN subject_type = 'Person' THEN 'biographical_location' ELSE 'context_location' END AS space_role FROM assertions")
def _(s, d):
    role = F.when(c("predicate") == "located_in", "relation_location").when((c("object_type") == "Place") & (c("subject_type") == "Event"), "event_location").when(c("subject_type") == "Person", "biographical_location").otherwise("context_location")
    return facts(s, d).select("fact_id", role.alias("space_role"))


@add("D07", "SELECT a.fact_id, greatest(a.risk_tier, s.risk_tier, o.risk_tier) AS risk, least(a.confidence, s.confidence, o.confidence) AS confidence, CASE WHEN s.entity_id IS NULL OR o.entity_id IS NULL THEN 'unresolved_endpoint' ELSE a.semantic_status END AS status FROM assertions a LEFT JOIN entities s ON s.entity_id = a.subject_id LEFT JOIN entities o ON o.entity_id = a.object_id")
def _(s, d):
    """The worst risk and least confidence of fact and ends; an unknown end overrides the status."""
    e = base.entities(s, d).select("entity_id", "risk_tier", "confidence")
    end = lambda k: e.select(c("entity_id").alias(f"{k}_id"), c("risk_tier").alias(f"{k}_risk"), c("confidence").alias(f"{k}_conf"), F.lit(True).alias(f"{k}_known"))
    a = facts(s, d).select("fact_id", "subject_id", "object_id", "risk_tier", "confidence", "semantic_status").join(end("subject"), "subject_id", "left").join(end("object"), "object_id", "left")
    return a.select("fact_id", F.greatest("risk_tier", "subject_risk", "object_risk").alias("risk"), F.least("confidence", "subject_conf", "object_conf").alias("confidence"), F.when(c("subject_known").isNull() | c("object_known").isNull(), "unresolved_endpoint").otherwise(c("semantic_status")).alias("status"))


@add("D08", "SELECT event_id, count(DISTINCT substr(occurrence_time_start, 1, 4)) AS years, max(substr(occurrence_time_end, 1, 4)::INTEGER) - min(substr(occurrence_time_start, 1, 4)::INTEGER) AS span FROM links WHERE occurrence_time_start IS NOT NULL GROUP BY 1 HAVING count(DISTINCT substr(occurrence_time_start, 1, 4)) > 1")
def _(s, d):
    year = lambda k: F.substring(k, 1, 4)
    g = base.links(s, d).filter("occurrence_time_start is not null").groupBy("event_id").agg(F.countDistinct(year("occurrence_time_start")).alias("years"), (F.max(year("occurrence_time_end").cast("int")) - F.min(year("occurrence_time_start").cast("int"))).alias("span"))
    return g.filter("years > 1")


@add("D09", "SELECT canonical_name, count(*) AS size, CASE WHEN count(*) >= 4 THEN 100 WHEN count(*) >= 2 THEN 20 ELSE 5 END AS priority FROM entities WHERE semantic_status IN ('pending', 'manual_review') GROUP BY 1")
def _(s, d):
    g = base.entities(s, d).filter(c("semantic_status").isin("pending", "manual_review")).groupBy("canonical_name").agg(F.count("*").alias("size"))
    return g.withColumn("priority", F.when(c("size") >= 4, 100).when(c("size") >= 2, 20).otherwise(5))


@add("D13", "SELECT e.entity_id, t.consensus FROM entities e JOIN (SELECT canonical_name, min(semantic_entity_type) AS consensus FROM entities WHERE semantic_status = 'auto_accepted' AND semantic_entity_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT semantic_entity_type) = 1) t ON t.canonical_name = e.canonical_name WHERE e.semantic_status <> 'auto_accepted'")
def _(s, d):
    e = base.entities(s, d)
    t = e.filter("semantic_status = 'auto_accepted' and semantic_entity_type is not null").groupBy("canonical_name").agg(F.min("semantic_entity_type").alias("consensus"), F.max("semantic_entity_type").alias("other")).filter("consensus = other")
    return e.filter("semantic_status <> 'auto_accepted'").select("entity_id", "canonical_name").join(t, "canonical_name").select("entity_id", "consensus")


@add("D18", "SELECT entity_id, regexp_matches(canonical_name, '^第?[一二三四五六七八九十0-9]+[团连营]$') OR canonical_name IN ('群众', '战士') AS ambiguous FROM entities")
def _(s, d):
    return base.entities(s, d).select("entity_id", (c("canonical_name").rlike("^第?[一二三四五六七八九十0-9]+[团连营]$") | c("canonical_name").isin("群众", "战士")).alias("ambiguous"))


@add("D20", "SELECT entity_id, first_value(entity_id) OVER (PARTITION BY source_entity_type, canonical_name ORDER BY CASE semantic_status WHEN 'auto_accepted' THEN 0 ELSE 1 END, confidence DESC NULLS LAST, member_count DESC, entity_id) AS canonical_id FROM entities WHERE source_entity_type = 'Place' UNION ALL SELECT entity_id, entity_id FROM entities WHERE source_entity_type IS DISTINCT FROM 'Place'")
def _(s, d):
    """Places of one name map to their representative, by a fixed order; all else to itself."""
    e = base.entities(s, d)
    order = F.struct(F.when(c("semantic_status") == "auto_accepted", 0).otherwise(1), -F.coalesce("confidence", F.lit(-1.0)), -c("member_count"), "entity_id")
    place = c("source_entity_type").eqNullSafe("Place")
    rep = e.filter(place).groupBy("canonical_name").agg(F.min_by("entity_id", order).alias("canonical_id"))
    mapped = e.filter(place).join(rep, "canonical_name").select("entity_id", "canonical_id")
    return mapped.unionByName(e.filter(~place).select("entity_id", c("entity_id").alias("canonical_id")))


# Each subtype and the type above it; a social group also stands for an organisation.
TYPE_PARENT = {
    "AdministrativeRegion": "Place", "BasinSection": "Place", "CulturalSite": "Place", "Organization": "SocialGroup", "Institution": "Organization",
    "Spirit": "Concept", "ValueFacet": "Concept", "Position": "Concept", "EvolutionStage": "TimePeriod",
}


def allowed(wanted: str) -> list[str]:
    """All types that pass for a wanted one: itself and whatever leads up to it."""
    targets = {wanted, "SocialGroup"} if wanted == "Organization" else {wanted}

    def up(t: str) -> list[str]:
        way = [t]
        while way[-1] in TYPE_PARENT:
            way.append(TYPE_PARENT[way[-1]])
        return way

    return sorted({wanted, *targets, *(t for t in TYPE_PARENT if targets & set(up(t)))})


_ALLOWED = ", ".join(f"('{p}', '{e}', '{t}')" for p, e, w in CONTRACT for t in allowed(w))
_CONTROLLED = ", ".join(f"'{p}'" for p, _, _ in CONTRACT)


@add("D22", f"SELECT fact_id, coalesce(predicate IN ({_CONTROLLED}) AND (predicate, CASE WHEN (predicate, 'subject') IN (SELECT (p, e) FROM (VALUES {_ALLOWED}) k(p, e, t)) THEN 'subject' ELSE 'object' END, CASE WHEN (predicate, 'subject') IN (SELECT (p, e) FROM (VALUES {_ALLOWED}) k(p, e, t)) THEN subject_type ELSE object_type END) IN (SELECT (p, e, t) FROM (VALUES {_ALLOWED}) k(p, e, t)), false) AS compatible FROM assertions")
def _(s, d):
    """Domain and range pass of the contract's relations, by type or any type above it; other relations don't pass."""
    ok = [F.when(c("predicate") == p, F.coalesce(c(f"{e}_type").isin(*allowed(t)), F.lit(False))) for p, e, t in CONTRACT]
    return facts(s, d).select("fact_id", F.coalesce(*ok, F.lit(False)).alias("compatible"))


@add("D24", "SELECT fact_id, CASE WHEN semantic_status = 'auto_accepted' AND predicate NOT LIKE 'raw:%' THEN 'strict_semantic' WHEN semantic_status IN ('auto_accepted', 'model_review') THEN 'contextual' ELSE 'unresolved' END AS tier FROM assertions")
def _(s, d):
    ok = c("semantic_status") == "auto_accepted"
    return facts(s, d).select("fact_id", F.when(ok & ~c("predicate").like("raw:%"), "strict_semantic").when(c("semantic_status").isin("auto_accepted", "model_review"), "contextual").otherwise("unresolved").alias("tier"))


@add("D29", "SELECT * FROM roles")
def _(s, d):
    return base.roles(s, d)


@add("D30", "SELECT subject_id AS source, object_id AS target, CASE predicate WHEN 'part_of' THEN 'structure' ELSE 'context' END AS relation, count(*) AS n FROM assertions WHERE subject_type = 'Event' AND object_type = 'Event' AND subject_id <> object_id GROUP BY 1, 2, 3")
def _(s, d):
    e = facts(s, d).filter("subject_type = 'Event' and object_type = 'Event' and subject_id <> object_id")
    return e.groupBy(c("subject_id").alias("source"), c("object_id").alias("target"), F.when(c("predicate") == "part_of", "structure").otherwise("context").alias("relation")).agg(F.count("*").alias("n"))


@add("D31", "SELECT * FROM frames")
def _(s, d):
    return base.frames(s, d)


@add("D33", "SELECT culture_subject_id, culture_form_code, CASE max(CASE observation_tier WHEN 'trusted_event_spacetime' THEN 3 WHEN 'asserted_event_spacetime' THEN 2 ELSE 1 END) WHEN 3 THEN 'confirmed' WHEN 2 THEN 'asserted' ELSE 'candidate' END AS status FROM states GROUP BY 1, 2")
def _(s, d):
    rank = F.max(F.when(c("observation_tier") == "trusted_event_spacetime", 3).when(c("observation_tier") == "asserted_event_spacetime", 2).otherwise(1))
    return base.states(s, d).groupBy("culture_subject_id", "culture_form_code").agg(F.element_at(F.array(*map(F.lit, ("candidate", "asserted", "confirmed"))), rank).alias("status"))


@add("D35", "SELECT * FROM cells")
def _(s, d):
    return base.cells(s, d)


@add("D36", "SELECT DISTINCT event_id AS subject_id, cell_id, 'self' AS via FROM cells UNION SELECT DISTINCT r.counterpart_id, c.cell_id, 'role' FROM roles r JOIN cells c ON c.event_id = r.event_id WHERE r.counterpart_id IS NOT NULL")
def _(s, d):
    """Events as their own subject, and the counterparts of their roles."""
    cells = base.cells(s, d).select("event_id", "cell_id")
    own = cells.select(c("event_id").alias("subject_id"), "cell_id", F.lit("self").alias("via"))
    others = base.roles(s, d).select("event_id", "counterpart_id").dropna().distinct().join(cells, "event_id")
    return own.unionByName(others.select(c("counterpart_id").alias("subject_id"), "cell_id", F.lit("role").alias("via"))).distinct()


@add("D37", "SELECT culture_subject_id, culture_form_code, stage_code, region_id, max(CASE observation_tier WHEN 'trusted_event_spacetime' THEN 3 WHEN 'asserted_event_spacetime' THEN 2 ELSE 1 END) AS rank, count(DISTINCT event_id) AS events, CASE WHEN count(DISTINCT event_id) >= 2 THEN 'stable_multi_event' WHEN max(CASE observation_tier WHEN 'relation_context' THEN 1 ELSE 2 END) >= 2 THEN 'explicit_single_event' ELSE 'context_candidate' END AS status FROM states s LEFT JOIN state_support u ON u.state_id = s.state_id LEFT JOIN links l ON l.fact_id = u.fact_id GROUP BY 1, 2, 3, 4")
def _(s, d):
    ev = base.state_support(s, d).select("state_id", "fact_id").distinct().join(base.links(s, d).select("fact_id", "event_id").distinct(), "fact_id").select("state_id", "event_id").distinct()
    rank = F.max(F.when(c("observation_tier") == "trusted_event_spacetime", 3).when(c("observation_tier") == "asserted_event_spacetime", 2).otherwise(1))
    g = base.states(s, d).join(ev, "state_id", "left").groupBy("culture_subject_id", "culture_form_code", "stage_code", "region_id").agg(rank.alias("rank"), F.countDistinct("event_id").alias("events"))
    return g.withColumn("status", F.when(c("events") >= 2, "stable_multi_event").when(c("rank") >= 2, "explicit_single_event").otherwise("context_candidate"))


@add("D39", "SELECT u.state_id, count(DISTINCT u.fact_id) AS facts, sum(m)::BIGINT AS members FROM (SELECT DISTINCT state_id, fact_id FROM state_support) u JOIN (SELECT fact_id, source_member_count AS m FROM assertions) a ON a.fact_id = u.fact_id GROUP BY 1")
def _(s, d):
    u = base.state_support(s, d).select("state_id", "fact_id").distinct().join(facts(s, d).select("fact_id", "source_member_count"), "fact_id")
    return u.groupBy("state_id").agg(F.count("*").alias("facts"), F.sum("source_member_count").alias("members"))


@add("D42", "SELECT * FROM candidates")
def _(s, d):
    return base.candidates(s, d)


QUERIES["D43"], SQL["D43"] = (lambda s, d: base.candidates(s, d).filter("rule_kind = 'spatial'")), over("SELECT * FROM candidates WHERE rule_kind = 'spatial'")
QUERIES["D44"], SQL["D44"] = (lambda s, d: base.candidates(s, d).groupBy("publication_gate_reason").agg(F.count("*").alias("n"))), over("SELECT publication_gate_reason, count(*) AS n FROM candidates GROUP BY 1")
QUERIES["D45"], SQL["D45"] = base.transitions, over("SELECT * FROM transitions")


@add("D50", "SELECT l.event_id, l.fact_id, c.cell_id, c.support_role FROM (SELECT DISTINCT event_id, fact_id FROM links) l JOIN cell_support c ON c.fact_id = l.fact_id")
def _(s, d):
    return base.links(s, d).select("event_id", "fact_id").distinct().join(base.cell_support(s, d), "fact_id").select("event_id", "fact_id", "cell_id", "support_role")


@add("D51", "SELECT fact_id, min(fact_id) OVER w AS canonical_id, CASE WHEN count(*) OVER w > 1 AND fact_id <> min(fact_id) OVER w THEN 'merged' WHEN count(*) OVER w > 1 THEN 'canonical' ELSE 'single' END AS status FROM assertions WINDOW w AS (PARTITION BY subject_id, predicate, object_id, coalesce(start_date, DATE '0001-01-01'), coalesce(end_date, DATE '0001-01-01'), coalesce(canonical_space_anchor_id, ''))")
def _(s, d):
    """Identity merge on a null-safe six-part key."""
    parts = ["subject_id", "predicate", "object_id", F.coalesce("start_date", F.lit("0001-01-01").cast("date")), F.coalesce("end_date", F.lit("0001-01-01").cast("date")), F.coalesce("canonical_space_anchor_id", F.lit(""))]
    w = W.partitionBy(*parts)
    low, n = F.min("fact_id").over(w), F.count("*").over(w)
    return facts(s, d).select("fact_id", low.alias("canonical_id"), F.when((n > 1) & (c("fact_id") != low), "merged").when(n > 1, "canonical").otherwise("single").alias("status"))


_DATED = "SELECT fact_id, subject_id, predicate, time_precision, start_date AS s, end_date AS e FROM assertions WHERE start_date <= end_date AND merged_into IS NULL AND research_tier = 'strict_semantic' AND subject_type = 'Event'"


@add("D54", f"SELECT a.fact_id AS a, b.fact_id AS b, CASE WHEN a.e < b.s THEN 'before' WHEN a.s > b.e THEN 'after' WHEN a.e = b.s THEN 'meets' WHEN a.s = b.s AND a.e = b.e THEN 'equals' WHEN a.s = b.s AND a.e < b.e THEN 'starts' WHEN a.e = b.e AND a.s > b.s THEN 'ends' WHEN a.s >= b.s AND a.e <= b.e THEN 'during' WHEN a.s <= b.s AND a.e >= b.e THEN 'contains' ELSE 'overlaps' END AS relation FROM ({_DATED}) a JOIN ({_DATED}) b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.fact_id < b.fact_id")
def _(s, d):
    """Allen relations of an event's dated, unmerged strict facts of one predicate, smaller id first; D54-FAMILIES has the whole."""
    f = facts(s, d).filter("start_date <= end_date and merged_into is null and research_tier = 'strict_semantic' and subject_type = 'Event'")
    rows = f.select("subject_id", "predicate", c("fact_id").alias("id"), c("start_date").alias("s"), c("end_date").alias("e"))
    met = pairs_within(rows, ["subject_id", "predicate"], c("a_id") < c("b_id"))
    return met.select(c("a_id").alias("a"), c("b_id").alias("b"), X.allen(c("a_s"), c("a_e"), c("b_s"), c("b_e")).alias("relation"))


PAIR_ROWS = 500


def _ordered(members: DataFrame, key: str, meets) -> DataFrame:
    return pairs_within(members, [key], (c("a_id") < c("b_id")) & meets, PAIR_ROWS)


def temporal_pairs(facts: DataFrame, links: DataFrame, support: DataFrame) -> DataFrame:
    """(a, b, relation, precision, family) of dated, unmerged facts: each pair once, in the first family that has it.

    facts: fact_id, subject_id, start_date, end_date, time_precision, merged_into. links: event_id, fact_id. support:
    culture_subject_id, state_id, fact_id. Families in order: same_subject; same_event; same_state_subject, facts of
    different states of one subject. Undated ends exclude a fact, dates in the wrong order do not; null keys pair
    nothing; repeated links count once. precision is the coarser known one: period, year, month, else unknown.
    """
    rank = F.when(c("time_precision") == "month", 1).when(c("time_precision") == "year", 2).when(c("time_precision") == "period", 3).otherwise(0)
    f = facts.filter("start_date is not null and end_date is not null and merged_into is null").select(c("fact_id").alias("id"), "subject_id", c("start_date").alias("s"), c("end_date").alias("e"), rank.alias("p"))
    apart = ~F.coalesce(c("a_subject_id") == c("b_subject_id"), F.lit(False))
    dated = lambda df: df.withColumnRenamed("fact_id", "id").join(f.withColumnRenamed("subject_id", "subject"), "id").withColumnRenamed("subject", "subject_id")
    event = dated(links.select("event_id", "fact_id").distinct())
    states = support.groupBy("culture_subject_id", "fact_id").agg(F.min("state_id").alias("low"), F.max("state_id").alias("high"))
    other_state = (c("a_low") != c("b_low")) | (c("a_low") != c("a_high")) | (c("b_low") != c("b_high"))
    ends = ["a_id", "b_id", "a_s", "a_e", "a_p", "b_s", "b_e", "b_p"]
    by_event = _ordered(event, "event_id", apart).select(*ends, F.lit(2).alias("family"))
    by_state = _ordered(dated(states), "culture_subject_id", apart & other_state).select(*ends, F.lit(3).alias("family"))
    rest = by_event.unionByName(by_state).groupBy(*ends).agg(F.min("family").alias("family"))
    every = _ordered(f, "subject_id", F.lit(True)).select(*ends, F.lit(1).alias("family")).unionByName(rest)
    name = lambda k, names: F.element_at(F.array(*map(F.lit, names)), k)
    return every.select(
        c("a_id").alias("a"), c("b_id").alias("b"), X.allen(c("a_s"), c("a_e"), c("b_s"), c("b_e")).alias("relation"),
        name(F.greatest("a_p", "b_p") + 1, ("unknown", "month", "year", "period")).alias("precision"),
        name(c("family"), ("same_subject", "same_event", "same_state_subject")).alias("family"),
    )


@add("D54-FAMILIES")
def _(s, d):
    """All Allen pairs of the reference (its U5); D54 is the part of it that D54's SQL states."""
    support = base.state_support(s, d).select("state_id", "fact_id").join(base.states(s, d).select("state_id", "culture_subject_id"), "state_id")
    return temporal_pairs(facts(s, d), base.links(s, d), support)


@add("D53", "SELECT a.event_id AS a, b.event_id AS b, CASE WHEN a.observed_end < b.observed_start THEN 'before' WHEN a.observed_start > b.observed_end THEN 'after' WHEN a.observed_start >= b.observed_start AND a.observed_end <= b.observed_end THEN 'during' ELSE 'overlaps' END AS relation FROM (SELECT DISTINCT x.event_id AS l, y.event_id AS r FROM roles x JOIN roles y ON x.counterpart_id = y.counterpart_id AND x.event_id < y.event_id) p JOIN frames a ON a.event_id = l JOIN frames b ON b.event_id = r WHERE a.observed_start IS NOT NULL AND b.observed_start IS NOT NULL AND a.observed_end IS NOT NULL AND b.observed_end IS NOT NULL")
def _(s, d):
    """J-INTERVAL-PAIR: only events that share a participant are compared; the pairs are distinct before they get dates."""
    who = base.roles(s, d).select("event_id", "counterpart_id").dropna().distinct()
    pairs = _ordered(who.withColumnRenamed("event_id", "id"), "counterpart_id", F.lit(True)).select(c("a_id").alias("a"), c("b_id").alias("b")).distinct()
    f = base.frames(s, d).filter("observed_start is not null and observed_end is not null")
    end = lambda k: f.select(c("event_id").alias(k), c("observed_start").alias(f"s{k}"), c("observed_end").alias(f"e{k}"))
    rel = F.when(c("ea") < c("sb"), "before").when(c("sa") > c("eb"), "after").when((c("sa") >= c("sb")) & (c("ea") <= c("eb")), "during").otherwise("overlaps")
    return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", rel.alias("relation"))


QUERIES["J-INTERVAL-PAIR"], SQL["J-INTERVAL-PAIR"] = QUERIES["D53"], SQL["D53"]


@add("D61", "WITH x AS (SELECT fact_id, merged_into FROM assertions) SELECT a.fact_id, coalesce(d.merged_into, cc.merged_into, b.merged_into, a.merged_into) AS root FROM x a LEFT JOIN x b ON b.fact_id = a.merged_into LEFT JOIN x cc ON cc.fact_id = b.merged_into LEFT JOIN x d ON d.fact_id = cc.merged_into WHERE a.merged_into IS NOT NULL")
def _(s, d):
    """Follows merged_into up to four steps."""
    x = cut(facts(s, d).select("fact_id", "merged_into").filter("merged_into is not null"))
    out = x.select("fact_id", c("merged_into").alias("root"))
    for _ in range(3):
        out = out.join(x.select(c("fact_id").alias("root"), c("merged_into").alias("nxt")), "root", "left").select("fact_id", F.coalesce("nxt", "root").alias("root"), c("nxt").isNull().alias("stop"))
        out = out.select("fact_id", "root")
    return out


SQL["D61"] = SQL["D61"].replace("\nWITH x AS", ", x AS")


@add("D75", r"SELECT doc_id, score, CASE WHEN score >= 4 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' WHEN score = 1 THEN 'LOW' ELSE 'NO_SIGNAL' END AS route FROM (SELECT doc_id, regexp_matches(text, '19\d{2}')::INTEGER + regexp_matches(text, '(县|市|镇|乡)')::INTEGER + regexp_matches(text, '(支队|团|旗)')::INTEGER + regexp_matches(text, '(会馆|码头|祠堂)')::INTEGER + regexp_matches(text, '(精神|传承)')::INTEGER + regexp_matches(text, '(运动|会议|转移)')::INTEGER AS score FROM documents WHERE text IS NOT NULL)")
def _(s, d):
    """Page screening: signals counted by patterns over whole texts, and a route by their number."""
    signals = [r"19\d{2}", "(县|市|镇|乡)", "(支队|团|旗)", "(会馆|码头|祠堂)", "(精神|传承)", "(运动|会议|转移)"]
    score = sum((c("text").rlike(p).cast("int") for p in signals), F.lit(0))
    t = table(s, d, "documents").filter("text is not null").select("doc_id", score.alias("score"))
    return t.withColumn("route", F.when(c("score") >= 4, "HIGH").when(c("score") >= 2, "MEDIUM").when(c("score") == 1, "LOW").otherwise("NO_SIGNAL"))


def _edges(s, d) -> DataFrame:
    return facts(s, d).filter("research_tier = 'strict_semantic' and subject_id is not null and object_id is not null").select(c("subject_id").alias("src"), c("object_id").alias("dst"), "predicate", "fact_id")


_E = "(SELECT subject_id AS src, object_id AS dst, predicate, fact_id FROM assertions WHERE research_tier = 'strict_semantic' AND subject_id IS NOT NULL AND object_id IS NOT NULL)"


# The integrity checks: conditions on one layer's rows, and references of one layer's key to another's.
ROW_CHECKS = {
    "assertions": {
        "confidence_out_of_range": "confidence < 0 or confidence > 1", "confidence_missing": "confidence is null", "merged_into_itself": "merged_into = fact_id",
        "start_after_end": "start_date > end_date", "start_unreadable": "time_start is not null and start_date is null", "end_unreadable": "time_end is not null and end_date is null",
        "unknown_research_tier": "research_tier not in ('strict_semantic', 'contextual', 'unresolved')", "predicate_missing": "predicate is null", "object_missing": "object_id is null",
        "no_source_member": "coalesce(source_member_count, 0) < 1", "subject_is_object": "subject_id = object_id",
    },
    "entities": {"blank_entity_name": "trim(coalesce(canonical_name, '')) = ''", "entity_without_type": "source_entity_type is null and semantic_entity_type is null", "no_entity_member": "coalesce(member_count, 0) < 1"},
    "states": {"stage_out_of_range": "stage_order is null or stage_order < 1 or stage_order > 8", "state_without_region": "region_id is null", "state_without_form": "culture_form_code is null"},
    "links": {"occurrence_after_end": "occurrence_time_start > occurrence_time_end"},
}
REFERENCE_CHECKS = {
    "assertion_without_subject": ("assertions", "subject_id", "entities", "entity_id"), "assertion_without_object": ("assertions", "object_id", "entities", "entity_id"),
    "merged_into_unknown": ("assertions", "merged_into", "assertions", "fact_id"), "anchor_without_place": ("assertions", "canonical_space_anchor_id", "entities", "entity_id"),
    "link_without_fact": ("links", "fact_id", "assertions", "fact_id"), "link_without_event": ("links", "event_id", "entities", "entity_id"),
    "cell_support_without_fact": ("cell_support", "fact_id", "assertions", "fact_id"), "state_support_without_fact": ("state_support", "fact_id", "assertions", "fact_id"),
    "state_support_without_state": ("state_support", "state_id", "states", "state_id"), "state_without_subject": ("states", "culture_subject_id", "entities", "entity_id"),
}
AUDITS = {k: f"SELECT count(*) FROM {layer} WHERE {q}" for layer, checks in ROW_CHECKS.items() for k, q in checks.items()} | {
    k: f"SELECT count(*) FROM {a} x WHERE x.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {b} y WHERE y.{ref} = x.{key})" for k, (a, key, b, ref) in REFERENCE_CHECKS.items()
}


@add("D76", " UNION ALL ".join(f"SELECT '{k}' AS check_name, ({q}) AS violations" for k, q in AUDITS.items()))
def _(s, d):
    """Integrity checks as counts of violations, one row per check. All conditions on a layer's rows are counted in one pass,
    references by one anti join each on the two keys."""
    layer = {k: getattr(base, k)(s, d) for k in ("assertions", "entities", "states", "links", "cell_support", "state_support")}
    out = None
    for name, checks in ROW_CHECKS.items():
        counts = layer[name].agg(*(F.count(F.when(F.expr(q), 1)).alias(k) for k, q in checks.items()))
        one = counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check_name"), c(k).alias("violations")) for k in checks))))
        out = one if out is None else out.unionByName(one)
    for name, (a, key, b, ref) in REFERENCE_CHECKS.items():
        gone = layer[a].filter(c(key).isNotNull()).select(key).join(layer[b].select(c(ref).alias(key)), key, "left_anti")
        out = out.unionByName(gone.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations"))
    return out


@add("G-VERIFY", "SELECT 'nodes' AS what, count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (caption = '') AS blank FROM (SELECT entity_id AS id, coalesce(trim(canonical_name), '') AS caption FROM entities) UNION ALL SELECT 'edges', count(*), count(DISTINCT fact_id), count(*) FILTER (coalesce(predicate, '') = '') FROM " + _E + " UNION ALL SELECT 'dangling', count(*), count(DISTINCT fact_id), 0 FROM " + _E + " WHERE src NOT IN (SELECT entity_id FROM entities) OR dst NOT IN (SELECT entity_id FROM entities)")
def _(s, d):
    """The graph's counts, ids and captions: nodes, edges, and edges with an end that is no node."""
    e, nodes = _edges(s, d), base.entities(s, d).select(c("entity_id").alias("id"), F.coalesce(F.trim("canonical_name"), F.lit("")).alias("caption"))
    blank = lambda x: F.count(F.when(x, 1)).alias("blank")
    of_nodes = nodes.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), blank(c("caption") == ""))
    of_edges = e.agg(F.count("*").alias("n"), F.countDistinct("fact_id").alias("ids"), blank(F.coalesce("predicate", F.lit("")) == ""))
    known = lambda k: nodes.select(c("id").alias(k), F.lit(1).alias(f"has_{k}"))
    loose = e.join(known("src"), "src", "left").join(known("dst"), "dst", "left").filter("has_src is null or has_dst is null")
    of_loose = loose.agg(F.count("*").alias("n"), F.countDistinct("fact_id").alias("ids"), F.lit(0).cast("long").alias("blank"))
    name = lambda df, what: df.select(F.lit(what).alias("what"), "n", "ids", "blank")
    return name(of_nodes, "nodes").unionByName(name(of_edges, "edges")).unionByName(name(of_loose, "dangling"))


@add("D80", "SELECT task_id, action_new, CASE WHEN reference_label IS NULL THEN 'unevaluable' WHEN action_new = 'UNRESOLVED' THEN 'abstain' WHEN (action_new = 'REWRITE' AND reference_label = 'AFTER_BETTER') OR (action_new = 'RETAIN' AND reference_label = 'BEFORE_BETTER') THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n FROM closure3_old_new_heldout GROUP BY 1, 2, 3")
def _(s, d):
    ok = ((c("action_new") == "REWRITE") & (c("reference_label") == "AFTER_BETTER")) | ((c("action_new") == "RETAIN") & (c("reference_label") == "BEFORE_BETTER"))
    outcome = F.when(c("reference_label").isNull(), "unevaluable").when(c("action_new") == "UNRESOLVED", "abstain").when(ok, "correct").otherwise("wrong")
    return table(s, d, "closure3_old_new_heldout").groupBy("task_id", "action_new", outcome.alias("outcome")).agg(F.count("*").alias("n"))


_TAIL = "(SELECT sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))) FROM (SELECT unnest(range(0, least(a, b) + 1)) AS i))"


@add("D79", f"SELECT type, a AS after, b AS before, round(p, 6) AS p_value, CASE WHEN a + b >= 20 AND p < 0.05 AND a > b THEN 'REWRITE' WHEN a + b >= 20 AND p < 0.05 THEN 'RETAIN' ELSE 'UNRESOLVED' END AS action FROM (SELECT *, CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2 * {_TAIL}) END AS p FROM (SELECT type, count(*) FILTER (reference_label = 'AFTER_BETTER') AS a, count(*) FILTER (reference_label = 'BEFORE_BETTER') AS b FROM closure3_old_new_heldout WHERE type IS NOT NULL GROUP BY 1))")
def _(s, d):
    """Per class of change: wins of after and before and the two-sided binomial test; classes are few."""
    wins = table(s, d, "closure3_old_new_heldout").filter("type is not null").groupBy("type").agg(F.sum((c("reference_label") == "AFTER_BETTER").cast("int")).alias("after"), F.sum((c("reference_label") == "BEFORE_BETTER").cast("int")).alias("before"))
    p = F.pandas_udf(lambda a, b: pd.Series([stats.binomial_two_sided(int(x), int(y)) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")
    w = wins.na.fill(0).withColumn("p_value", p("after", "before"))
    decided = (c("after") + c("before") >= 20) & (c("p_value") < 0.05)
    return w.withColumn("action", F.when(decided & (c("after") > c("before")), "REWRITE").when(decided, "RETAIN").otherwise("UNRESOLVED")).withColumn("p_value", F.round("p_value", 6))


# graph and search
_HUB = f"(SELECT id FROM (SELECT src AS id FROM {_E} UNION ALL SELECT dst FROM {_E}) GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 1)"


def _hub(s, d) -> str:
    row = graph.degrees(_edges(s, d)).orderBy(F.desc("degree"), "id").first()
    return row["id"] if row else ""


@add("G-COUNTS", "SELECT source_entity_type AS label, count(*) AS n FROM entities GROUP BY 1")
def _(s, d):
    return base.entities(s, d).groupBy(c("source_entity_type").alias("label")).agg(F.count("*").alias("n"))


@add("G-META", "SELECT stage_order, stage_code, stage_label_zh FROM stages")
def _(s, d):
    return base.stages(s, d).select("stage_order", "stage_code", "stage_label_zh").orderBy("stage_order")


@add("G-OVERVIEW", f"SELECT src, dst, count(*) AS n FROM {_E} WHERE src IN (SELECT id FROM (SELECT src AS id FROM {_E} UNION ALL SELECT dst FROM {_E}) GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 70) AND dst IN (SELECT id FROM (SELECT src AS id FROM {_E} UNION ALL SELECT dst FROM {_E}) GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 70) GROUP BY 1, 2")
def _(s, d):
    """The subgraph of the 70 nodes of highest degree."""
    e = _edges(s, d)
    top = graph.degrees(e).orderBy(F.desc("degree"), "id").limit(70).select("id")
    return graph.induced(e, top).groupBy("src", "dst").agg(F.count("*").alias("n"))


@add("G-ENTITY", f"SELECT fact_id, 'out' AS direction, dst AS neighbour FROM {_E} WHERE src = {_HUB} UNION ALL SELECT fact_id, 'in', src FROM {_E} WHERE dst = {_HUB}")
def _(s, d):
    return graph.neighbours(_edges(s, d), _hub(s, d)).select("fact_id", "direction", "neighbour")


@add("H-NEIGHBORS", f"SELECT neighbour, predicate, direction, count(*) AS facts FROM (SELECT predicate, 'out' AS direction, dst AS neighbour FROM {_E} WHERE src = {_HUB} UNION ALL SELECT predicate, 'in', src FROM {_E} WHERE dst = {_HUB}) WHERE predicate NOT LIKE 'raw:%' GROUP BY ALL ORDER BY facts DESC, neighbour, predicate, direction LIMIT 50")
def _(s, d, page=50):
    """The first page of a node's neighbours, by relation and direction, raw relations filtered out."""
    rows = graph.neighbours(_edges(s, d).filter(~c("predicate").like("raw:%")), _hub(s, d))
    return rows.groupBy("neighbour", "predicate", "direction").agg(F.count("*").alias("facts")).orderBy(F.desc("facts"), "neighbour", "predicate", "direction").limit(page)


@add("G-INDUCED", f"SELECT fact_id, src, dst, predicate FROM {_E} WHERE src IN (SELECT entity_id FROM entities WHERE risk_tier = 'A') AND dst IN (SELECT entity_id FROM entities WHERE risk_tier = 'A')")
def _(s, d):
    """The edges with both ends in a chosen set of nodes of any size; edges with a missing end go."""
    chosen = base.entities(s, d).filter("risk_tier = 'A'").select(c("entity_id").alias("id"))
    return graph.induced(_edges(s, d), chosen).select("fact_id", "src", "dst", "predicate")


@add("G-EXPLORE", "SELECT s.culture_subject_id, s.state_id, l.event_id, count(DISTINCT u.fact_id) AS n FROM states s JOIN state_support u ON u.state_id = s.state_id JOIN links l ON l.fact_id = u.fact_id WHERE stage_code = 'stg_siege' GROUP BY 1, 2, 3")
def _(s, d, stage="stg_siege"):
    rows = base.states(s, d).filter(c("stage_code") == stage).select("culture_subject_id", "state_id").join(base.state_support(s, d).select("state_id", "fact_id").distinct(), "state_id").join(base.links(s, d).select("fact_id", "event_id").distinct(), "fact_id")
    return rows.groupBy("culture_subject_id", "state_id", "event_id").agg(F.countDistinct("fact_id").alias("n"))


@add("H-STATS", "SELECT research_tier, count(*) AS n, min(start_date) AS first, max(end_date) AS last FROM assertions GROUP BY 1")
def _(s, d):
    return facts(s, d).groupBy("research_tier").agg(F.count("*").alias("n"), F.min("start_date").alias("first"), F.max("end_date").alias("last"))


_DEG = f"(SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {_E} UNION ALL SELECT dst FROM {_E}) GROUP BY 1)"


@add("H-SEARCH", f"SELECT entity_id, canonical_name, coalesce(degree, 0) AS degree FROM (SELECT * FROM entities WHERE canonical_name ILIKE '%county%' OR aliases_json ILIKE '%county%' ORDER BY canonical_name NOT ILIKE 'county%', length(canonical_name), entity_id LIMIT 400) LEFT JOIN {_DEG} ON id = entity_id ORDER BY degree DESC, entity_id LIMIT 20")
def _(s, d, q="county"):
    """S-TWO-STAGE-TOPK: 400 by prefix and length, then 20 of them by degree."""
    e = base.entities(s, d).filter(c("canonical_name").ilike(f"%{q}%") | c("aliases_json").ilike(f"%{q}%"))
    first = e.orderBy(~c("canonical_name").ilike(f"{q}%"), F.length("canonical_name"), "entity_id").limit(400).select("entity_id", "canonical_name")
    deg = graph.degrees(_edges(s, d)).withColumnRenamed("id", "entity_id")
    return first.join(deg, "entity_id", "left").na.fill(0, ["degree"]).orderBy(F.desc("degree"), "entity_id").limit(20)


QUERIES["S-TWO-STAGE-TOPK"], SQL["S-TWO-STAGE-TOPK"] = QUERIES["H-SEARCH"], SQL["H-SEARCH"]


@add("H-ENTITY", "SELECT id, count(*) AS degree, min(s) AS active_from, max(e) AS active_to FROM (SELECT subject_id AS id, start_date AS s, end_date AS e FROM assertions UNION ALL SELECT object_id, start_date, end_date FROM assertions) WHERE id IS NOT NULL GROUP BY 1")
def _(s, d):
    ends = facts(s, d).select(F.explode(F.array("subject_id", "object_id")).alias("id"), "start_date", "end_date").filter("id is not null")
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.min("start_date").alias("active_from"), F.max("end_date").alias("active_to"))


@add("H-EVIDENCE", "SELECT fact_id, cell_id, support_role FROM (SELECT a.fact_id, cell_id, support_role, row_number() OVER (PARTITION BY a.fact_id ORDER BY cell_id, support_role) AS r FROM assertions a JOIN cell_support c ON c.fact_id = a.fact_id) WHERE r <= 6")
def _(s, d):
    """Up to six provenance rows of each fact: a top-k report."""
    rows = facts(s, d).select("fact_id").join(base.cell_support(s, d), "fact_id")
    r = F.row_number().over(W.partitionBy("fact_id").orderBy("cell_id", "support_role"))
    return rows.withColumn("r", r).filter("r <= 6").select("fact_id", "cell_id", "support_role")


@add("H-PATH")
def _(s, d):
    """From the hub to the smallest node among those three steps away or nearer."""
    e, hub = _edges(s, d), _hub(s, d)
    far = e.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.min("id")).first()[0]
    return graph.shortest_path(e, hub, far or "")


# statistics
_RUN = "SELECT event_id, event_type AS method, least(greatest(round(value / 100 + 1e-9, 2), 0), 1) AS score, ((props->>'k')::BIGINT % 2)::INTEGER AS correct, (user_id % 7 <> 0) AS gate FROM events"


def runs(s, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    score = F.least(F.greatest(F.round(c("value") / 100 + 1e-9, 2), F.lit(0.0)), F.lit(1.0))
    return table(s, d, "events").select("event_id", c("event_type").alias("method"), score.alias("score"), (k % 2).cast("int").alias("correct"), (c("user_id") % 7 != 0).alias("gate"))


_CURVE = f"SELECT method, score, cn / total AS coverage, ce / cn AS risk, ce / total AS general_risk FROM (SELECT method, score, sum(n) OVER (PARTITION BY method ORDER BY score DESC)::DOUBLE AS cn, sum(e) OVER (PARTITION BY method ORDER BY score DESC)::DOUBLE AS ce, sum(n) OVER (PARTITION BY method)::DOUBLE AS total FROM (SELECT method, score, count(*) AS n, sum(1 - correct) AS e FROM ({_RUN}) GROUP BY 1, 2)) UNION ALL SELECT DISTINCT method, NULL, 0, 0, 0 FROM ({_RUN})"
_CURVE_ALL = f"SELECT score, cn / total AS coverage, ce / cn AS risk, ce / total AS general_risk FROM (SELECT score, sum(n) OVER (ORDER BY score DESC)::DOUBLE AS cn, sum(e) OVER (ORDER BY score DESC)::DOUBLE AS ce, sum(n) OVER ()::DOUBLE AS total FROM (SELECT score, count(*) AS n, sum(1 - correct) AS e FROM ({_RUN}) GROUP BY 1)) UNION ALL SELECT DISTINCT NULL, 0, 0, 0 FROM ({_RUN})"
_r = lambda df, *cols: df.withColumns({k: F.round(k, 9) for k in cols})


@add("M-RC-CURVE", f"SELECT method, score, round(coverage, 9) AS coverage, round(risk, 9) AS risk, round(general_risk, 9) AS general_risk FROM ({_CURVE})")
def _(s, d):
    return _r(stats.risk_coverage(runs(s, d), ["method"]), "coverage", "risk", "general_risk")


QUERIES["W-CUMULATIVE-TIES"], SQL["W-CUMULATIVE-TIES"] = QUERIES["M-RC-CURVE"], SQL["M-RC-CURVE"]


@add("M-AURC", f"SELECT method, round(sum((coverage - pc) * (risk + pr) / 2), 9) AS aurc, round(sum((coverage - pc) * (general_risk + pg) / 2), 9) AS augrc FROM (SELECT *, lag(coverage) OVER w AS pc, lag(risk) OVER w AS pr, lag(general_risk) OVER w AS pg FROM ({_CURVE}) WINDOW w AS (PARTITION BY method ORDER BY coverage)) GROUP BY 1")
def _(s, d):
    return _r(stats.areas(stats.risk_coverage(runs(s, d), ["method"]), ["method"]), "aurc", "augrc")


@add("M-RC-CURVE-ROWS", f"SELECT event_id, method, round(sum(1 - correct) OVER w / row_number() OVER w, 9) AS risk FROM ({_RUN}) WINDOW w AS (PARTITION BY method ORDER BY score DESC, correct, event_id ROWS UNBOUNDED PRECEDING)")
def _(s, d):
    """W-CUMULATIVE: one point per accepted row."""
    rows = runs(s, d).select("event_id", "method", "score", "correct")
    at = running(rows, ["method"], [F.desc("score"), c("correct"), c("event_id")], {"errors": 1 - c("correct")})
    return at.select("event_id", "method", F.round(c("errors") / c("__place"), 9).alias("risk"))


@add("M-COVERAGE", f"SELECT method, round(avg(a), 9) AS coverage, round(sum(a * (1 - correct)) / nullif(sum(a), 0)::DOUBLE, 9) AS selective_risk, round(1 - sum(a * (1 - correct)) / nullif(sum(a), 0)::DOUBLE, 9) AS selective_accuracy, round(avg(a * (1 - correct)), 9) AS general_risk, round(avg(a * correct), 9) AS safe_coverage, round(sum(a * (1 - correct)) / nullif(sum(1 - correct), 0)::DOUBLE, 9) AS error_exposure FROM (SELECT *, (score >= 0.5 AND gate)::INTEGER AS a FROM ({_RUN})) GROUP BY 1")
def _(s, d):
    """Accepted by score and hard gate."""
    out = stats.selective_summary(runs(s, d).withColumn("accepted", (c("score") >= 0.5) & c("gate")), ["method"])
    return _r(out, *out.columns[1:])


@add("M-AUROC", f"SELECT method, round((sum(k * (below + (n + 1) / 2.0)) - sum(k)::DOUBLE * (sum(k) + 1) / 2) / (sum(k)::DOUBLE * (sum(n) - sum(k))), 9) AS auroc FROM (SELECT *, sum(n) OVER (PARTITION BY method ORDER BY score)::DOUBLE - n AS below FROM (SELECT method, score, count(*) AS n, sum(1 - correct) AS k FROM ({_RUN}) GROUP BY 1, 2)) GROUP BY 1")
def _(s, d):
    return _r(stats.auroc(runs(s, d).withColumn("positive", 1 - c("correct")), ["method"]), "auroc")


@add("M-WILSON", f"SELECT method, round((p + 1.9207294103470602 / n - 1.959963984540054 * sqrt(p * (1 - p) / n + 0.9603647051735301 / (n * n))) / (1 + 3.8414588206941205 / n), 6) AS low, round((p + 1.9207294103470602 / n + 1.959963984540054 * sqrt(p * (1 - p) / n + 0.9603647051735301 / (n * n))) / (1 + 3.8414588206941205 / n), 6) AS high FROM (SELECT method, avg(correct) AS p, count(*)::DOUBLE AS n FROM ({_RUN}) GROUP BY 1)")
def _(s, d):
    g = runs(s, d).groupBy("method").agg(F.sum("correct").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(c("k"), c("n"))
    return g.select("method", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@add("M-PREDICTOR", f"SELECT round(sum(n * abs(s - k)) / sum(n), 6) AS ece, round(sum(q) / sum(n), 6) AS brier FROM (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, avg(score) AS s, avg(correct) AS k, sum((score - correct) * (score - correct)) AS q FROM ({_RUN}) GROUP BY 1)")
def _(s, d):
    return _r(stats.calibration(runs(s, d)), "ece", "brier").withColumns({k: F.round(k, 6) for k in ("ece", "brier")})


_V = "(SELECT task_id AS item, rater_id AS rater, min(label) AS label FROM (SELECT task_id, rater_id, rtrim(ltrim(regexp_replace(upper(label), '[^A-Z]+', '_', 'g'), '_'), '_') AS label FROM closure3_votes) WHERE label IN ('AFTER_BETTER', 'BEFORE_BETTER', 'BOTH_WRONG', 'INSUFFICIENT_EVIDENCE') GROUP BY 1, 2)"


def _ballots(s, d) -> DataFrame:
    label = F.regexp_replace(F.regexp_replace(F.upper("label"), "[^A-Z]+", "_"), "^_+|_+$", "")
    v = table(s, d, "closure3_votes").select(c("task_id").alias("item"), c("rater_id").alias("rater"), label.alias("label"))
    return v.filter(c("label").isin("AFTER_BETTER", "BEFORE_BETTER", "BOTH_WRONG", "INSUFFICIENT_EVIDENCE")).groupBy("item", "rater").agg(F.min("label").alias("label"))


@add("M-CONSENSUS", f"SELECT item, CASE WHEN k >= t THEN label END AS label, CASE WHEN k >= t + 1 THEN 'strong' WHEN k >= t THEN 'weak' ELSE 'unresolved' END AS tier FROM (SELECT item, label, n AS k, CASE WHEN sum(n) OVER (PARTITION BY item) >= 5 THEN 3 ELSE 2 END AS t, row_number() OVER (PARTITION BY item ORDER BY n DESC, label) AS r FROM (SELECT item, label, count(*) AS n FROM {_V} GROUP BY 1, 2)) WHERE r = 1")
def _(s, d):
    return stats.vote_consensus(_ballots(s, d))


@add("M-KRIPPENDORFF", f"SELECT round(1 - o * (total - 1) / (total * total - sq), 9) AS alpha FROM (SELECT sum(n * (m - n) / (m - 1)::DOUBLE) AS o, sum(n)::DOUBLE AS total FROM (SELECT *, sum(n) OVER (PARTITION BY item) AS m FROM (SELECT item, label, count(*) AS n FROM {_V} GROUP BY 1, 2)) WHERE m > 1), (SELECT sum(n * n)::DOUBLE AS sq FROM (SELECT label, sum(n) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY item) AS m FROM (SELECT item, label, count(*) AS n FROM {_V} GROUP BY 1, 2)) WHERE m > 1 GROUP BY 1))")
def _(s, d):
    return _r(stats.krippendorff_alpha(_ballots(s, d).groupBy("item", "label").agg(F.count("*").alias("n"))), "alpha")


@add("M-PAIRWISE-AGREE", f"SELECT a.rater AS a, b.rater AS b, count(*) AS n, round(avg((a.label = b.label)::INTEGER), 6) AS agreement FROM {_V} a JOIN {_V} b ON a.item = b.item AND a.rater < b.rater GROUP BY 1, 2")
def _(s, d):
    """Pairs of raters per item, of whom there are few; summed on the map side."""
    v = _ballots(s, d)
    a, b = v.select("item", c("rater").alias("a"), c("label").alias("la")), v.select("item", c("rater").alias("b"), c("label").alias("lb"))
    return a.join(b, "item").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg((c("la") == c("lb")).cast("int")), 6).alias("agreement"))


@add("M-MACRO-F1", "SELECT round(avg(f), 9) AS macro_f1 FROM (SELECT t.y, 2.0 * tp / (t + coalesce(p, 0)) AS f FROM (SELECT source_entity_type AS y, count(*) AS t, sum((source_entity_type = coalesce(semantic_entity_type, ''))::INTEGER) AS tp FROM entities WHERE source_entity_type IS NOT NULL GROUP BY 1) t LEFT JOIN (SELECT semantic_entity_type AS y, count(*) AS p FROM entities WHERE semantic_entity_type IS NOT NULL AND source_entity_type IS NOT NULL GROUP BY 1) p ON p.y = t.y)")
def _(s, d):
    rows = base.entities(s, d).filter("source_entity_type is not null").select(c("source_entity_type").alias("y_true"), c("semantic_entity_type").alias("y_pred"))
    return _r(stats.macro_f1(rows), "macro_f1")
