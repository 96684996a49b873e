"""Queries of the general data problems (2 to 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.hierarchy import code_key, descendant_pairs, hierarchy
from factloom.operators.intervals import merge_intervals, partial_date
from factloom.operators.orphans import Reference, Target, orphan_references, orphan_report
from factloom.session import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "research_event_relations").select("source_event_id", "target_event_id", "relation_code")
    return hierarchy(rows.filter(code_key(F.col("relation_code")) == "partof"), "source_event_id", "target_event_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select(
        F.col("node").alias("event_id"), F.col("root").alias("root_id"), F.col("depth").alias("tree_depth"), F.col("path").alias("id_path"), "cycle_state"
    )


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Descendants of each event, counted and by their greatest distance."""
    pairs = descendant_pairs(_events(spark, sf))
    return pairs.groupBy(F.col("ancestor").alias("event_id")).agg(
        F.count("*").alias("n_descendants"), F.max("distance").alias("height")
    )


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name, *cols: table(spark, sf, name).select(*cols, "ingested_at")
    refs = [
        Reference("research_event_cell_support", t("research_event_cell_support", "fact_id"), "fact_id", "research_assertions"),
        Reference("research_event_assertion_links", t("research_event_assertion_links", "event_id"), "event_id", "v2_entities"),
        Reference("research_culture_state_support", t("research_culture_state_support", "state_id"), "state_id", "research_culture_states"),
    ]
    targets = [
        Target("research_assertions", t("research_assertions", "fact_id"), "fact_id"),
        Target("v2_entities", t("v2_entities", "entity_id"), "entity_id"),
        Target("research_culture_states", t("research_culture_states", "state_id"), "state_id"),
    ]
    return orphan_references(refs, targets, table(spark, sf, "record_tombstones"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """table_name is the referring table."""
    return _orphans(spark, sf)


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "v2_assertion_scopes").select(
        "subject_id", partial_date(F.col("time_start"), False).alias("s"), partial_date(F.col("time_end"), True).alias("e")
    )
    return merge_intervals(rows, "subject_id", "s", "e").select(
        "subject_id", "kind", F.date_format("start", "yyyy-MM-dd").alias("start_date"), F.date_format("end", "yyyy-MM-dd").alias("end_date")
    )


QUERIES = {"p2_found": p2_found, "p2_descendants": p2_descendants, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found}

_P2 = r"""
WITH RECURSIVE links AS (
  SELECT source_event_id AS node, min(target_event_id) AS parent FROM research_event_relations
  WHERE regexp_replace(lower(nfkc), '[^a-z]', '', 'g') = 'partof' AND source_event_id IS NOT NULL AND target_event_id IS NOT NULL
  GROUP BY 1),
nodes AS (SELECT node FROM links UNION SELECT parent FROM links),
up AS (
  SELECT node, node AS here, 0::BIGINT AS depth, [node] AS trail, false AS closed FROM nodes
  UNION ALL
  SELECT up.node, l.parent, depth + 1, list_append(trail, l.parent), list_contains(trail, l.parent)
  FROM up JOIN links l ON l.node = up.here WHERE NOT closed),
ends AS (SELECT * FROM up WHERE closed OR here NOT IN (SELECT node FROM links)),
split AS (
  SELECT node, closed, depth, trail, here, list_position(trail, here) AS pos FROM ends),
found AS (
  SELECT node AS event_id,
    CASE WHEN closed THEN list_min(trail[pos:len(trail) - 1]) ELSE here END AS root_id,
    CASE WHEN closed THEN pos - 1 ELSE depth END::BIGINT AS tree_depth,
    array_to_string(list_reverse(CASE WHEN closed THEN trail[1:pos] ELSE trail END), '>') AS id_path,
    CASE WHEN NOT closed THEN 'none' WHEN pos = 1 THEN 'on' ELSE 'below' END AS cycle_state
  FROM split)
"""
_P2 = _P2.replace(
    "lower(nfkc)", "lower(translate(relation_code, 'ｐａｒｔ＿ｏｆＰＡＲＴＯＦ', 'part_ofPARTOF'))"
)
_REFS = """
WITH refs AS (
  SELECT 'research_event_cell_support' AS table_name, fact_id AS ref_id, ingested_at AS seen, 'research_assertions' AS target FROM research_event_cell_support
  UNION ALL SELECT 'research_event_assertion_links', event_id, ingested_at, 'v2_entities' FROM research_event_assertion_links
  UNION ALL SELECT 'research_culture_state_support', state_id, ingested_at, 'research_culture_states' FROM research_culture_state_support),
recs AS (
  SELECT 'research_assertions' AS target, fact_id AS id, min(ingested_at) AS born FROM research_assertions GROUP BY 2
  UNION ALL SELECT 'v2_entities', entity_id, min(ingested_at) FROM v2_entities GROUP BY 2
  UNION ALL SELECT 'research_culture_states', state_id, min(ingested_at) FROM research_culture_states GROUP BY 2),
dead AS (SELECT target_table AS target, record_id AS id, min(deleted_at) AS died FROM record_tombstones GROUP BY 1, 2),
found AS (
  SELECT DISTINCT table_name, ref_id, strftime(seen, '%Y-%m') AS ref_month,
    CASE WHEN died <= seen THEN 'deleted' WHEN recs.id IS NULL THEN 'missing' WHEN born > seen THEN 'late' END AS reason
  FROM refs LEFT JOIN recs ON recs.target = refs.target AND recs.id = ref_id LEFT JOIN dead ON dead.target = refs.target AND dead.id = ref_id
  WHERE ref_id IS NOT NULL)
"""
_P4 = r"""
WITH raw AS (
  SELECT subject_id, trim(translate(time_start, '０１２３４５６７８９', '0123456789')) AS a, trim(translate(time_end, '０１２３４５６７８９', '0123456789')) AS b
  FROM v2_assertion_scopes),
cleaned AS (
  SELECT subject_id,
    regexp_replace(regexp_replace(split_part(a, ' ', 1), '[年月/.]', '-', 'g'), '日$|-$', '') AS a,
    regexp_replace(regexp_replace(split_part(b, ' ', 1), '[年月/.]', '-', 'g'), '日$|-$', '') AS b
  FROM raw),
dated AS (
  SELECT DISTINCT subject_id,
    CASE WHEN regexp_full_match(a, '\d{4}') THEN try_cast(a || '-01-01' AS DATE)
         WHEN regexp_full_match(a, '\d{4}-\d{1,2}') THEN try_cast(a || '-01' AS DATE)
         WHEN regexp_full_match(a, '\d{4}-\d{1,2}-\d{1,2}') THEN try_cast(a AS DATE) END AS s,
    CASE WHEN regexp_full_match(b, '\d{4}') THEN try_cast(b || '-12-31' AS DATE)
         WHEN regexp_full_match(b, '\d{4}-\d{1,2}') THEN last_day(try_cast(b || '-01' AS DATE))
         WHEN regexp_full_match(b, '\d{4}-\d{1,2}-\d{1,2}') THEN try_cast(b AS DATE) END AS e
  FROM cleaned),
marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY subject_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new
  FROM dated WHERE subject_id IS NOT NULL AND s <= e),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY subject_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM marked),
periods AS (SELECT subject_id, min(s) AS s, max(e) AS e FROM grouped GROUP BY subject_id, grp),
gaps AS (SELECT subject_id, e + 1 AS s, lead(s) OVER (PARTITION BY subject_id ORDER BY s) - 1 AS e FROM periods)
SELECT subject_id, 'period' AS kind, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date FROM periods
UNION ALL SELECT subject_id, 'gap', strftime(s, '%Y-%m-%d'), strftime(e, '%Y-%m-%d') FROM gaps WHERE e IS NOT NULL
"""

SQL = {
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_descendants": _P2
    + """, pairs AS (SELECT event_id, tree_depth, unnest(string_split(id_path, '>')) AS ancestor, unnest(range(0, tree_depth + 1)) AS pos FROM found)
SELECT ancestor AS event_id, count(*) AS n_descendants, max(tree_depth - pos) AS height FROM pairs WHERE pos < tree_depth GROUP BY 1""",
    "p3_found": _REFS + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p3_report": _REFS + "SELECT table_name, ref_month, reason, count(*) AS n_references FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
    "p4_found": _P4,
}
