"""The 26 competency queries over the research base, event and state layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.plans import base
from factloom.plans.base import over

ORGS, WORKS = ["Organization", "Institution", "SocialGroup"], ["CreativeWork", "Document", "Artifact", "Spirit", "ValueFacet", "Concept"]
# Kinds of media by a word of the title.
MEDIA = {"diary": "日记", "song": "之歌", "ballad": "小调", "woodcut": "木刻", "report": "报告", "newsletter": "通讯", "chronicle": "纪事"}


def media_type(name: Column) -> Column:
    out = F.lit("unknown")
    for kind, word in reversed(MEDIA.items()):
        out = F.when(name.contains(word), kind).otherwise(out)
    return out


def _n(cond: Column | None = None, of: str | None = None) -> Column:
    if of:
        return F.countDistinct(F.when(cond, F.col(of)) if cond is not None else F.col(of))
    return F.sum(F.when(cond, 1).otherwise(0))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """States, subjects, events and facts per stage, region, form and tier, before any coarser sum."""
    s, sup = base.states(spark, sf), base.state_support(spark, sf).select("state_id", "fact_id").distinct()
    ev = base.links(spark, sf).select("fact_id", "event_id").distinct()
    fan = s.join(sup, "state_id", "left").join(ev, "fact_id", "left")
    return fan.groupBy("stage_code", "region_id", "culture_form_code", "observation_tier").agg(
        _n(of="state_id").alias("state_count"), _n(of="culture_subject_id").alias("entity_count"), _n(of="event_id").alias("event_count"), _n(of="fact_id").alias("supporting_fact_count")
    )


def cq01(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of distinct counts per region, which may count one event twice: kept as the query defines it."""
    keys = ["stage_order", "stage_code", "stage_label_zh", "culture_form_code", "observation_tier"]
    sums = [F.sum(c).alias(c) for c in ("state_count", "entity_count", "event_count", "supporting_fact_count")]
    return metrics(spark, sf).join(base.stages(spark, sf), "stage_code").groupBy(*keys).agg(*sums).orderBy("stage_order", "culture_form_code", "observation_tier")


def cq02(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics(spark, sf).join(base.stages(spark, sf), "stage_code").join(base.regions(spark, sf), "region_id")
    return rows.orderBy("stage_order", "region_id", "culture_form_code", "observation_tier").select(
        "stage_order", "stage_code", "province_name", "culture_form_code", "observation_tier", "state_count", "entity_count", "event_count"
    )


def cq03(spark: SparkSession, sf: str) -> DataFrame:
    s, sup = base.states(spark, sf), base.state_support(spark, sf).select("state_id", "fact_id").distinct()
    ev = sup.join(base.links(spark, sf).select("fact_id", "event_id").distinct(), "fact_id").select("state_id", "event_id").distinct()
    keys = ["stage_order", "stage_code", "basin_section_id", "culture_form_code", "observation_tier"]
    return s.join(ev, "state_id").groupBy(*keys).agg(F.count("*").alias("state_count"), _n(of="culture_subject_id").alias("entity_count"), _n(of="event_id").alias("event_count")).orderBy(*keys)


def cq04(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["stage_order", "stage_code", "stage_label_zh", "observation_tier"]
    counts = base.states(spark, sf).groupBy(*keys).agg(F.count("*").alias("state_count"))
    total = F.sum("state_count").over(W.partitionBy("stage_code"))
    return counts.withColumn("state_share", F.round(F.col("state_count") / total, 6)).orderBy("stage_order", "observation_tier")


def cq05(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["observed_time_status", "frame_status"]
    sums = [F.sum(c).alias(c) for c in ("occurrence_time_fact_count", "trusted_time_fact_count", "event_location_fact_count")]
    return base.frames(spark, sf).groupBy(*keys).agg(F.count("*").alias("event_count"), *sums).orderBy(*keys)


def cq06(spark: SparkSession, sf: str) -> DataFrame:
    c = base.cells(spark, sf).filter("observation_tier = 'trusted_event_spacetime'")
    f = base.frames(spark, sf).select("event_id", "controlled_role_count")
    kind = F.col("counterpart_type")
    r = base.roles(spark, sf).groupBy("event_id").agg(  # per event before the join, so that cells don't fan out
        _n(kind == "Person", "counterpart_id").alias("person_count"), _n(kind.isin(ORGS), "counterpart_id").alias("organization_count"), _n(kind.isin(WORKS), "counterpart_id").alias("culture_object_count")
    )
    counts = ["person_count", "organization_count", "culture_object_count"]
    rows = c.join(f, "event_id").join(r, "event_id", "left").na.fill(0, counts)
    return rows.select("event_id", "event_name", "stage_code", "stage_label_zh", "province_name", "controlled_role_count", *counts).orderBy(
        F.desc("culture_object_count"), F.desc("person_count"), F.desc("organization_count"), "event_name"
    )


def _timeline(who: str, types: list[str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = base.roles(spark, sf).filter(F.col("counterpart_type").isin(types))
        rows = r.join(base.cells(spark, sf), "event_id").orderBy("counterpart_name", "stage_order", "province_name", "event_name", "fact_id")
        return rows.select(
            F.col("counterpart_id").alias(f"{who}_id"), F.col("counterpart_name").alias(f"{who}_name"), "event_id", "event_name", "role_code", "stage_code", "province_name", "observation_tier", "fact_id"
        )

    return run


def cq10(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["culture_subject_name", "culture_form_code", "stage_order", "province_name", "observation_tier"]
    return base.states(spark, sf).select("culture_subject_id", "culture_subject_type", "stage_label_zh", "basin_section_id", "supporting_fact_count", "supporting_event_count", *keys).orderBy(*keys)


def _both_states(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """J-SELF-DUAL: the state dimension on either end."""
    s = base.states(spark, sf)
    end = lambda p: s.select(*(F.col(c).alias(f"{p}_{c}") for c in ("state_id", "culture_subject_name", "culture_subject_type", "stage_label_zh", "province_name")))
    return df.join(end("from"), "from_state_id").join(end("to"), "to_state_id")


def cq11(spark: SparkSession, sf: str) -> DataFrame:
    rows = _both_states(base.transitions(spark, sf), spark, sf)
    names = {"from_culture_subject_name": "from_subject", "from_stage_label_zh": "from_stage", "from_province_name": "from_province", "to_culture_subject_name": "to_subject", "to_stage_label_zh": "to_stage", "to_province_name": "to_province"}
    return rows.select("transition_id", "transition_type", "supporting_fact_count", "confidence", *(F.col(a).alias(b) for a, b in names.items())).orderBy("transition_type", "from_subject", "to_subject")


def cq12(spark: SparkSession, sf: str) -> DataFrame:
    return base.candidates(spark, sf).groupBy("publication_gate_reason", "publication_eligible").agg(
        F.count("*").alias("candidate_count"), F.countDistinct("from_state_id", "to_state_id").alias("distinct_state_pairs"), F.countDistinct("supporting_fact_id").alias("distinct_supporting_facts")
    ).orderBy(F.desc("publication_eligible"), F.desc("candidate_count"))


def cq13(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["memorialized_as", "transformed_into", "institutionalized_as", "adapted_as", "digitized_as"]
    t = base.transitions(spark, sf).select("transition_id", "transition_type", "from_state_id", "to_state_id")
    c = base.candidates(spark, sf).filter(F.col("transition_type").isin(kinds)).join(t, ["transition_type", "from_state_id", "to_state_id"], "left")
    own = F.when(F.col("publication_eligible") == 1, F.col("transition_id"))
    return _both_states(c, spark, sf).select(
        F.when(F.col("publication_eligible") == 1, "published").otherwise("candidate").alias("publication_status"), F.coalesce(own, "candidate_id").alias("candidate_or_transition_id"),
        "transition_type", F.col("from_culture_subject_name").alias("source_subject"), F.col("from_culture_subject_type").alias("source_type"), F.col("to_culture_subject_name").alias("target_subject"),
        F.col("to_culture_subject_type").alias("target_type"), F.col("to_stage_label_zh").alias("stage_label_zh"), F.col("to_province_name").alias("province_name"), "supporting_fact_id",
    ).orderBy(F.desc("publication_status"), "transition_type", "source_subject", "target_subject")


def cq14(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts tied to concepts."""
    rows = base.assertions(spark, sf).filter("subject_type = 'Concept' and object_type = 'Concept'")
    return rows.select(F.col("subject_id").alias("spirit_id"), F.col("subject_name").alias("spirit_name"), F.col("object_id").alias("value_facet_id"), F.col("object_name").alias("value_facet_name"), F.col("predicate").alias("relation_code"), "fact_id").orderBy("spirit_name", "value_facet_name", "fact_id")


def cq15(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoint swap: the concept is the spirit, the other end its manifestation."""
    rows = base.assertions(spark, sf).filter("(subject_type = 'Concept') <> (object_type = 'Concept') and research_tier <> 'unresolved'")
    swap = lambda c: F.when(F.col("subject_type") == "Concept", F.col(f"subject_{c}")).otherwise(F.col(f"object_{c}"))
    other = lambda c: F.when(F.col("subject_type") == "Concept", F.col(f"object_{c}")).otherwise(F.col(f"subject_{c}"))
    return rows.select(swap("id").alias("spirit_id"), swap("name").alias("spirit_name"), other("id").alias("target_id"), other("name").alias("target_name"), other("type").alias("target_type"), "predicate", "research_tier", "fact_id").orderBy("spirit_name", "target_name", "fact_id")


def cq16(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.states(spark, sf).filter("culture_subject_type = 'Concept'").join(base.state_support(spark, sf).select("state_id", "fact_id").distinct(), "state_id", "left")
    return rows.groupBy(F.col("culture_subject_id").alias("value_facet_id"), F.col("culture_subject_name").alias("value_facet_name")).agg(
        _n(of="stage_order").alias("stage_count"), _n(of="region_id").alias("region_count"), F.min("stage_order").alias("first_observed_stage_order"), F.max("stage_order").alias("last_observed_stage_order"),
        _n(of="state_id").alias("state_count"), _n(of="fact_id").alias("supporting_fact_count"),
    ).orderBy(F.desc("stage_count"), "value_facet_name")


def cq17(spark: SparkSession, sf: str) -> DataFrame:
    works = base.entities(spark, sf).filter("source_entity_type = 'CreativeWork'").withColumn("media_type", media_type(F.col("canonical_name")))
    counts = works.groupBy("media_type").agg(F.count("*").alias("work_count"), F.countDistinct("method_version").alias("classification_method_count"), _n(F.col("media_type") == "unknown").alias("unknown_count"))
    return counts.withColumn("share", F.round(F.col("work_count") / F.sum("work_count").over(W.partitionBy()), 6)).orderBy(F.desc("work_count"), "media_type")


def cq18(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.states(spark, sf).filter("culture_subject_type = 'CreativeWork'").withColumn("media_type", media_type(F.col("culture_subject_name")))
    return rows.select(F.col("culture_subject_id").alias("work_id"), F.col("culture_subject_name").alias("work_name"), "media_type", "stage_order", "stage_label_zh", "province_name", "basin_section_id", "observation_tier", "supporting_fact_count").orderBy("work_name", "stage_order", "province_name")


def cq19(spark: SparkSession, sf: str) -> DataFrame:
    """Provenance by tier; sources are counted per fact before the join."""
    per_fact = base.cell_support(spark, sf).groupBy("fact_id").agg(F.count("*").alias("n"))
    rows = base.assertions(spark, sf).select("fact_id", "research_tier").join(per_fact, "fact_id", "left")
    out = rows.groupBy("research_tier").agg(F.count("*").alias("assertion_count"), F.sum(F.coalesce("n", F.lit(0))).alias("provenance_count"), _n(F.col("n").isNull()).alias("assertions_without_provenance"))
    return out.withColumn("average_sources_per_assertion", F.round(F.col("provenance_count") / F.col("assertion_count"), 6)).orderBy("research_tier")


def cq20(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["research_tier", "semantic_status"]
    return base.assertions(spark, sf).groupBy(*keys).agg(F.count("*").alias("assertion_count"), F.sum("source_member_count").alias("source_member_count"), _n(F.col("start_date").isNotNull()).alias("time_known_count"), _n(F.col("province").isNotNull()).alias("space_known_count")).orderBy(*keys)


def cq21(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.coalesce("time_role", F.lit("unknown")).alias("time_role"), F.coalesce("time_precision", F.lit("unknown")).alias("time_precision")]
    return base.assertions(spark, sf).groupBy(*keys).agg(F.count("*").alias("assertion_count"), _n(F.col("start_date").isNotNull()).alias("normalized_time_count"), _n(of="subject_id").alias("owner_count")).orderBy("time_role", "time_precision")


def cq22(spark: SparkSession, sf: str) -> DataFrame:
    return base.assertions(spark, sf).groupBy("space_role").agg(F.count("*").alias("assertion_count"), _n(F.col("canonical_space_anchor_id").isNotNull()).alias("anchor_count"), _n(F.col("province").isNotNull()).alias("province_count"), _n(of="province").alias("distinct_provinces")).orderBy("space_role")


def cq23(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.col("source_entity_type").alias("entity_type"), F.col("semantic_status").alias("type_validation_status")]
    return base.entities(spark, sf).groupBy(*keys).agg(F.count("*").alias("entity_count"), F.sum("member_count").alias("integrated_member_count"), _n(F.col("aliases_json") != "[]").alias("alias_entity_count")).orderBy("entity_type", "type_validation_status")


def cq24(spark: SparkSession, sf: str) -> DataFrame:
    return base.entities(spark, sf).filter("member_count > 1").select("entity_id", "canonical_name", F.col("source_entity_type").alias("entity_type"), F.col("member_count").alias("integrated_member_count"), "aliases_json", F.col("semantic_status").alias("type_validation_status")).orderBy(F.desc("integrated_member_count"), "entity_id")


def first_observed(spark: SparkSession, sf: str) -> DataFrame:
    """D41, W-FIRST-OBSERVED: a subject's states of a form in its first stage, ties kept."""
    first = F.min("stage_order").over(W.partitionBy("culture_subject_id", "culture_form_code"))
    return base.states(spark, sf).withColumn("first_order", first).filter("stage_order = first_order")


def cq25(spark: SparkSession, sf: str) -> DataFrame:
    return first_observed(spark, sf).select("state_id", "culture_subject_id", "culture_subject_name", "culture_form_code", "stage_order", "stage_label_zh", "province_name", "observation_tier", F.col("state_status").alias("observation_status"), "supporting_fact_count").orderBy("culture_subject_name", "culture_form_code", "province_name")


def cq26(spark: SparkSession, sf: str) -> DataFrame:
    """Four groupings as one pass over grouping sets."""
    dims = ["research_tier", "semantic_status", "risk_tier", "time_precision"]
    flat = base.assertions(spark, sf).select("source_member_count", F.explode(F.create_map(*[x for d in dims for x in (F.lit(d), F.coalesce(d, F.lit("null")))])).alias("boundary_dimension", "boundary_value"))
    return flat.groupBy("boundary_dimension", "boundary_value").agg(F.count("*").alias("assertion_count"), F.sum("source_member_count").alias("source_member_count")).orderBy("boundary_dimension", "boundary_value")


QUERIES = {f"CQ{i:02d}": f for i, f in enumerate([cq01, cq02, cq03, cq04, cq05, cq06, _timeline("person", ["Person"]), _timeline("organization", ORGS), _timeline("place", ["Place"]), cq10, cq11, cq12, cq13, cq14, cq15, cq16, cq17, cq18, cq19, cq20, cq21, cq22, cq23, cq24, cq25, cq26], 1)}
QUERIES |= {"D41": first_observed, "D46": metrics}

_METRICS = "(SELECT stage_code, region_id, culture_form_code, observation_tier, count(DISTINCT s.state_id) AS state_count, count(DISTINCT culture_subject_id) AS entity_count, count(DISTINCT event_id) AS event_count, count(DISTINCT u.fact_id) AS supporting_fact_count FROM states s LEFT JOIN state_support u ON u.state_id = s.state_id LEFT JOIN links l ON l.fact_id = u.fact_id GROUP BY 1, 2, 3, 4)"
_MEDIA_SQL = lambda c: "CASE " + " ".join(f"WHEN contains({c}, '{w}') THEN '{k}'" for k, w in MEDIA.items()) + " ELSE 'unknown' END"
_ENDS = "JOIN states f ON f.state_id = c.from_state_id JOIN states x ON x.state_id = c.to_state_id"


def _timeline_sql(who: str, types: list[str]) -> str:
    return f"SELECT counterpart_id AS {who}_id, counterpart_name AS {who}_name, r.event_id, event_name, role_code, stage_code, province_name, observation_tier, fact_id FROM roles r JOIN cells c ON c.event_id = r.event_id WHERE counterpart_type IN ({', '.join(map(repr, types))})"


_SQL = {
    "CQ01": f"SELECT h.stage_order, m.stage_code, h.stage_label_zh, culture_form_code, observation_tier, sum(state_count)::BIGINT AS state_count, sum(entity_count)::BIGINT AS entity_count, sum(event_count)::BIGINT AS event_count, sum(supporting_fact_count)::BIGINT AS supporting_fact_count FROM {_METRICS} m JOIN stages h ON h.stage_code = m.stage_code GROUP BY 1, 2, 3, 4, 5",
    "CQ02": f"SELECT h.stage_order, m.stage_code, province_name, culture_form_code, observation_tier, state_count, entity_count, event_count FROM {_METRICS} m JOIN stages h ON h.stage_code = m.stage_code JOIN regions r ON r.region_id = m.region_id",
    "CQ03": "SELECT stage_order, stage_code, basin_section_id, culture_form_code, observation_tier, count(*) AS state_count, count(DISTINCT culture_subject_id) AS entity_count, count(DISTINCT event_id) AS event_count FROM states s JOIN (SELECT DISTINCT state_id, event_id FROM state_support u JOIN links l ON l.fact_id = u.fact_id) e ON e.state_id = s.state_id GROUP BY 1, 2, 3, 4, 5",
    "CQ04": "SELECT s.stage_order, s.stage_code, stage_label_zh, observation_tier, count(*) AS state_count, round(1.0 * count(*) / t.total, 6)::DOUBLE AS state_share FROM states s JOIN (SELECT stage_code, count(*)::DOUBLE AS total FROM states GROUP BY 1) t ON t.stage_code = s.stage_code GROUP BY 1, 2, 3, 4, t.total",
    "CQ05": "SELECT observed_time_status, frame_status, count(*) AS event_count, sum(occurrence_time_fact_count)::BIGINT AS occurrence_time_fact_count, sum(trusted_time_fact_count)::BIGINT AS trusted_time_fact_count, sum(event_location_fact_count)::BIGINT AS event_location_fact_count FROM frames GROUP BY 1, 2",
    "CQ06": f"SELECT c.event_id, c.event_name, stage_code, stage_label_zh, province_name, controlled_role_count, count(DISTINCT CASE WHEN counterpart_type = 'Person' THEN counterpart_id END) AS person_count, count(DISTINCT CASE WHEN counterpart_type IN ({', '.join(map(repr, ORGS))}) THEN counterpart_id END) AS organization_count, count(DISTINCT CASE WHEN counterpart_type IN ({', '.join(map(repr, WORKS))}) THEN counterpart_id END) AS culture_object_count FROM cells c JOIN frames f ON f.event_id = c.event_id LEFT JOIN roles r ON r.event_id = c.event_id WHERE c.observation_tier = 'trusted_event_spacetime' GROUP BY c.cell_id, 1, 2, 3, 4, 5, 6",
    "CQ07": _timeline_sql("person", ["Person"]),
    "CQ08": _timeline_sql("organization", ORGS),
    "CQ09": _timeline_sql("place", ["Place"]),
    "CQ10": "SELECT culture_subject_id, culture_subject_type, stage_label_zh, basin_section_id, supporting_fact_count, supporting_event_count, culture_subject_name, culture_form_code, stage_order, province_name, observation_tier FROM states",
    "CQ11": f"SELECT transition_id, transition_type, c.supporting_fact_count, confidence, f.culture_subject_name AS from_subject, f.stage_label_zh AS from_stage, f.province_name AS from_province, x.culture_subject_name AS to_subject, x.stage_label_zh AS to_stage, x.province_name AS to_province FROM transitions c {_ENDS}",
    "CQ12": "SELECT publication_gate_reason, publication_eligible, count(*) AS candidate_count, count(DISTINCT from_state_id || chr(31) || to_state_id) AS distinct_state_pairs, count(DISTINCT supporting_fact_id) AS distinct_supporting_facts FROM candidates GROUP BY 1, 2",
    "CQ13": f"SELECT CASE WHEN publication_eligible = 1 THEN 'published' ELSE 'candidate' END AS publication_status, CASE WHEN publication_eligible = 1 THEN t.transition_id ELSE candidate_id END AS candidate_or_transition_id, c.transition_type, f.culture_subject_name AS source_subject, f.culture_subject_type AS source_type, x.culture_subject_name AS target_subject, x.culture_subject_type AS target_type, x.stage_label_zh, x.province_name, supporting_fact_id FROM candidates c {_ENDS} LEFT JOIN transitions t ON t.transition_type = c.transition_type AND t.from_state_id = c.from_state_id AND t.to_state_id = c.to_state_id WHERE c.transition_type IN ('memorialized_as', 'transformed_into', 'institutionalized_as', 'adapted_as', 'digitized_as')",
    "CQ14": "SELECT subject_id AS spirit_id, subject_name AS spirit_name, object_id AS value_facet_id, object_name AS value_facet_name, predicate AS relation_code, fact_id FROM assertions WHERE subject_type = 'Concept' AND object_type = 'Concept'",
    "CQ15": "SELECT subject_id AS spirit_id, subject_name AS spirit_name, object_id AS target_id, object_name AS target_name, object_type AS target_type, predicate, research_tier, fact_id FROM assertions WHERE subject_type = 'Concept' AND object_type <> 'Concept' AND research_tier <> 'unresolved' UNION ALL SELECT object_id, object_name, subject_id, subject_name, subject_type, predicate, research_tier, fact_id FROM assertions WHERE subject_type <> 'Concept' AND object_type = 'Concept' AND research_tier <> 'unresolved'",
    "CQ16": "SELECT culture_subject_id AS value_facet_id, culture_subject_name AS value_facet_name, count(DISTINCT stage_order) AS stage_count, count(DISTINCT region_id) AS region_count, min(stage_order) AS first_observed_stage_order, max(stage_order) AS last_observed_stage_order, count(DISTINCT s.state_id) AS state_count, count(DISTINCT fact_id) AS supporting_fact_count FROM states s LEFT JOIN state_support u ON u.state_id = s.state_id WHERE culture_subject_type = 'Concept' GROUP BY 1, 2",
    "CQ17": f"SELECT {_MEDIA_SQL('canonical_name')} AS media_type, count(*) AS work_count, count(DISTINCT method_version) AS classification_method_count, sum(CASE WHEN {_MEDIA_SQL('canonical_name')} = 'unknown' THEN 1 ELSE 0 END)::BIGINT AS unknown_count, round(count(*)::DOUBLE / t.n, 6) AS share FROM entities CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM entities WHERE source_entity_type = 'CreativeWork') t WHERE source_entity_type = 'CreativeWork' GROUP BY 1, t.n",
    "CQ18": f"SELECT culture_subject_id AS work_id, culture_subject_name AS work_name, {_MEDIA_SQL('culture_subject_name')} AS media_type, stage_order, stage_label_zh, province_name, basin_section_id, observation_tier, supporting_fact_count FROM states WHERE culture_subject_type = 'CreativeWork'",
    "CQ19": "SELECT research_tier, count(DISTINCT a.fact_id) AS assertion_count, count(c.fact_id) AS provenance_count, count(DISTINCT CASE WHEN c.fact_id IS NULL THEN a.fact_id END) AS assertions_without_provenance, round(count(c.fact_id)::DOUBLE / count(DISTINCT a.fact_id), 6) AS average_sources_per_assertion FROM assertions a LEFT JOIN cell_support c ON c.fact_id = a.fact_id GROUP BY 1",
    "CQ20": "SELECT research_tier, semantic_status, count(*) AS assertion_count, sum(source_member_count)::BIGINT AS source_member_count, count(start_date) AS time_known_count, count(province) AS space_known_count FROM assertions GROUP BY 1, 2",
    "CQ21": "SELECT coalesce(time_role, 'unknown') AS time_role, coalesce(time_precision, 'unknown') AS time_precision, count(*) AS assertion_count, count(start_date) AS normalized_time_count, count(DISTINCT subject_id) AS owner_count FROM assertions GROUP BY 1, 2",
    "CQ22": "SELECT space_role, count(*) AS assertion_count, count(canonical_space_anchor_id) AS anchor_count, count(province) AS province_count, count(DISTINCT province) AS distinct_provinces FROM assertions GROUP BY 1",
    "CQ23": "SELECT source_entity_type AS entity_type, semantic_status AS type_validation_status, count(*) AS entity_count, sum(member_count)::BIGINT AS integrated_member_count, count(*) FILTER (aliases_json <> '[]') AS alias_entity_count FROM entities GROUP BY 1, 2",
    "CQ24": "SELECT entity_id, canonical_name, source_entity_type AS entity_type, member_count AS integrated_member_count, aliases_json, semantic_status AS type_validation_status FROM entities WHERE member_count > 1",
    "CQ25": "SELECT state_id, s.culture_subject_id, culture_subject_name, s.culture_form_code, stage_order, stage_label_zh, province_name, observation_tier, state_status AS observation_status, supporting_fact_count FROM states s JOIN (SELECT culture_subject_id, culture_form_code, min(stage_order) AS o FROM states GROUP BY 1, 2) m ON m.culture_subject_id = s.culture_subject_id AND m.culture_form_code = s.culture_form_code AND m.o = stage_order",
    "CQ26": " UNION ALL ".join(f"SELECT '{d}' AS boundary_dimension, coalesce({d}, 'null') AS boundary_value, count(*) AS assertion_count, sum(source_member_count)::BIGINT AS source_member_count FROM assertions GROUP BY 2" for d in ("research_tier", "semantic_status", "risk_tier", "time_precision")),
    "D41": "SELECT s.*, o AS first_order FROM states s JOIN (SELECT culture_subject_id, culture_form_code, min(stage_order) AS o FROM states GROUP BY 1, 2) m ON m.culture_subject_id IS NOT DISTINCT FROM s.culture_subject_id AND m.culture_form_code IS NOT DISTINCT FROM s.culture_form_code AND m.o = stage_order",
    "D46": f"SELECT * FROM {_METRICS}",
}
SQL = {k: over(v) for k, v in _SQL.items()}
SQL["D41"] = SQL["D41"].replace("SELECT s.*, o AS", "SELECT s.* EXCLUDE (rn), o AS")
