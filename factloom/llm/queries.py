"""Queries of the text and algorithm problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.bpe import encode, token_counts
from factloom.llm.components import record_groups
from factloom.llm.consensus import clean_label, clean_votes, consensus, item_agreement, named_by_most, named_or_not, naming_votes, spectral_reliability
from factloom.llm.glyphs import look_alike_classes, look_alike_pairs
from factloom.llm.mentions import mentions
from factloom.llm.names import name_groups, record_forms, variant_groups, variant_pairs
from factloom.llm.packing import fill_report, pack
from factloom.llm.pii import personal_items, redact
from factloom.session import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    entities = table(spark, sf, "v2_entities").select("entity_id", "canonical_name")
    named = mentions(table(spark, sf, "page001_5_35").select("page_id", "vote", "parsed"), repeated=True)
    return look_alike_pairs(entities, "entity_id", "canonical_name").unionByName(
        look_alike_pairs(named, "mention", "name", ["page_id"])
    )


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Entities and mentions whose name is written in two ways at least, with the form that all of its class share."""
    entities = table(spark, sf, "v2_entities").select("entity_id", "canonical_name")
    named = mentions(table(spark, sf, "page001_5_35").select("page_id", "vote", "parsed"), repeated=True)
    of_entities = look_alike_classes(entities, "entity_id", "canonical_name").withColumn("page_id", F.lit(None).cast("long"))
    return of_entities.unionByName(look_alike_classes(named, "mention", "name", ["page_id"]))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "research_assertions").select(
        F.lit("fact").alias("space"), F.col("fact_id").alias("record_id"), F.col("merged_into").alias("via")
    )
    tasks = table(spark, sf, "closure3_old_new_heldout").select(
        F.lit("task").alias("space"), F.col("task_id").alias("record_id"), F.concat(F.lit("component "), "component_id").alias("via")
    )
    return record_groups(facts.unionByName(tasks)).select("record_id", "group_id")


ENTITY_NAMES = ["entity_id", "canonical_name", "source_entity_type", "semantic_entity_type", "aliases_json"]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    named = mentions(table(spark, sf, "page001_5_35").select("page_id", "vote", "parsed"))
    return variant_pairs(table(spark, sf, "v2_entities").select(*ENTITY_NAMES), named)


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every record and mention of a name that is spelled in several ways, with its group and the group's counts."""
    named = mentions(table(spark, sf, "page001_5_35").select("page_id", "vote", "parsed"))
    return variant_groups(table(spark, sf, "v2_entities").select(*ENTITY_NAMES), named)


VOTE_LABELS = ["AFTER_BETTER", "BEFORE_BETTER", "BOTH_WRONG", "INSUFFICIENT_EVIDENCE"]


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return clean_votes(table(spark, sf, "closure3_votes"), "task_id", "rater_id", "label", VOTE_LABELS, "cast_at")


def _page_naming(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Passes that could be read, and the entities that they name, in whatever characters or spelling."""
    pages = table(spark, sf, "page001_5_35").select("page_id", "vote", "parsed")
    own, said, named, aliases = record_forms(table(spark, sf, "v2_entities").select(*ENTITY_NAMES), mentions(pages))
    groups = name_groups(named, aliases)
    group_of = lambda df: df.join(groups, "form", "left").withColumn("group", F.coalesce("group", "form"))
    known = group_of(own).select("group", "entity_id").distinct()
    naming = group_of(said).join(known, "group").select("page_id", "vote", "entity_id")
    return pages.filter(F.col("parsed").isNotNull()), naming


def _page_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that most passes of a page name."""
    passes, naming = _page_naming(spark, sf)
    return named_by_most(passes, naming, "page_id", "vote", "entity_id")


def _page_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Each pass as a rater of whether its page names an entity; the item is page and entity."""
    v = naming_votes(*_page_naming(spark, sf), "page_id", "vote", "entity_id")
    item = F.concat_ws("\x1f", F.col("item").cast("string"), "label")
    return cut(v.select(item.alias("item"), F.concat(F.lit("pass "), F.col("rater").cast("string")).alias("rater"), F.col("said").alias("label")))


SHARPEN = 2  # one number per rater mislabels what a rater of swapped labels decides; the README gives both figures


def _task_labels(spark: SparkSession, sf: str, votes: DataFrame, sharpen: int) -> DataFrame:
    """(item, consensus) of every task; one without any valid vote gets the label that is the consensus of most tasks."""
    best, _ = consensus(votes, VOTE_LABELS, sharpen)
    usual = best.groupBy("consensus").count().orderBy(F.desc("count"), "consensus").first()
    tasks = table(spark, sf, "closure3_votes").select(F.col("task_id").alias("item")).dropna().distinct()
    return tasks.join(best, "item", "left").select("item", F.coalesce("consensus", F.lit(usual[0] if usual else None)).alias("consensus"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks by spectral weights sharpened by confusions, and the entities that most passes of a page name."""
    voted = _task_labels(spark, sf, cut(_votes(spark, sf)), SHARPEN).select(F.col("item").alias("item_id"), F.col("consensus").alias("label"))
    pages = _page_consensus(spark, sf).select(F.col("page_id").cast("string").alias("item_id"), F.col("entity_id").alias("label"))
    return voted.unionByName(pages)


def p7_spectral(spark: SparkSession, sf: str) -> DataFrame:
    """The tasks' labels as the spectral weights alone decide."""
    return _task_labels(spark, sf, cut(_votes(spark, sf)), 0).select(F.col("item").alias("item_id"), F.col("consensus").alias("label"))


def _rated(votes: DataFrame, best: DataFrame, reliability: DataFrame) -> DataFrame:
    hits = votes.join(best, "item").groupBy("rater").agg(F.round(F.avg((F.col("label") == F.col("consensus")).cast("double")), 6).alias("consensus_share"))
    return reliability.join(hits, "rater").withColumnRenamed("rater", "rater_id")


def p7_raters(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability of each rater of tasks and each pass over pages, and the share of its votes that are the consensus."""
    votes = cut(_votes(spark, sf))
    pages = _page_votes(spark, sf)
    passes = _rated(pages, named_or_not(pages), spectral_reliability(pages, ["named", "not_named"]))
    return _rated(votes, *consensus(votes, VOTE_LABELS, SHARPEN)).unionByName(passes)


def p7_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement on each task, and on each entity (entity_id, null for tasks) that some pass of a page names.

    Tasks without a valid vote have n_votes 0: their label is the usual one, not a consensus.
    """
    votes, pages = cut(_votes(spark, sf)), _page_votes(spark, sf)
    tasks = item_agreement(votes, _task_labels(spark, sf, votes, SHARPEN)).withColumn("entity_id", F.lit(None).cast("string"))
    both = item_agreement(pages, named_or_not(pages))
    split = {"item": F.substring_index("item", "\x1f", 1), "entity_id": F.substring_index("item", "\x1f", -1)}
    return tasks.unionByName(both.withColumns(split))


def compared(best: DataFrame, heldout: DataFrame) -> DataFrame:
    """(item_id, consensus, reference_label, consensus_tier, agrees): tasks with a reference or tier beside their consensus.

    agrees is null without a reference; a task without a vote has a null consensus and does not agree.
    """
    known = heldout.filter("task_id is not null and (reference_label is not null or consensus_tier is not null)").select(F.col("task_id").alias("item"), "reference_label", "consensus_tier").distinct()
    agrees = F.when(F.col("reference_label").isNotNull(), F.coalesce(F.col("consensus") == clean_label(F.col("reference_label")), F.lit(False)))
    return known.join(best, "item", "left").select(F.col("item").alias("item_id"), "consensus", "reference_label", "consensus_tier", agrees.alias("agrees"))


def p7_reference(spark: SparkSession, sf: str) -> DataFrame:
    best, _ = consensus(cut(_votes(spark, sf)), VOTE_LABELS, SHARPEN)
    return compared(best, table(spark, sf, "closure3_old_new_heldout"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def p9_packing(spark: SparkSession, sf: str) -> DataFrame:
    counts = token_counts(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return pack(counts, table(spark, sf, "packing_profiles"), "doc_id")


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p9_packing(spark, sf), table(spark, sf, "packing_profiles"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal_items(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redact(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p7_spectral": p7_spectral,
    "p7_raters": p7_raters,
    "p7_agreement": p7_agreement,
    "p7_reference": p7_reference,
    "p8_ids": p8_ids,
    "p9_packing": p9_packing,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_THIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_ALIKE = ("АВЕКМНОРСТХІЅЈаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΧΥο‧・･", "ABEKMHOPCTXISJaeopcyxsijABEZHIKMNOPTXYo···")
_SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_RADICALS = (
    "⼀⼆⼈⼉⼋⼚⼝⼤⼥⼩⼭⼯⼽⽀⽂⽇⽊⽐⽓⽔⽕⽡⽢⽣⽪⽯⽶⽼⾕⾥",
    "一二人儿八厂口大女小山工戈支文日木比气水火瓦甘生皮石米老谷里",
)
_FROM = (_WIDE + _ALIKE[0] + _SPACES + _RADICALS[0]).replace("'", "''")
_TO = (_THIN + _ALIKE[1] + " " * len(_SPACES) + _RADICALS[1]).replace("'", "''")
_FORM = (
    "nfc_normalize(translate(regexp_replace(name, '[\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]', '', 'g'), "
    f"'{_FROM}', '{_TO}'))"
)
_MENTIONS = """
flat AS (SELECT page_id, vote, unnest(parsed.entities) AS e, unnest(range(len(parsed.entities))) AS pos FROM (SELECT DISTINCT page_id, vote, parsed FROM page001_5_35 WHERE parsed IS NOT NULL)),
mentions AS (
  SELECT DISTINCT printf('P%09d/%d/%03d', page_id, vote, pos) AS id, page_id AS scope, e.name AS name FROM flat WHERE e.name IS NOT NULL)
"""
_FORMED = f"""
WITH {_MENTIONS},
names AS (
  SELECT DISTINCT entity_id AS id, -1 AS scope, canonical_name AS name FROM v2_entities WHERE entity_id IS NOT NULL AND canonical_name IS NOT NULL
  UNION ALL SELECT * FROM mentions),
formed AS (SELECT *, {_FORM} AS form FROM names)
"""
SQL = {
    "p1_classes": f"""{_FORMED},
sizes AS (SELECT scope, form, count(*) AS n_ids, count(DISTINCT name) AS n_spellings FROM formed GROUP BY 1, 2)
SELECT nullif(f.scope, -1) AS page_id, f.form, f.id, f.name AS text, n_ids, n_spellings FROM formed f JOIN sizes s ON s.scope = f.scope AND s.form = f.form WHERE n_spellings > 1
""",
    "p1_found": f"""{_FORMED}
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM formed a JOIN formed b ON a.form = b.form AND a.scope = b.scope AND a.id < b.id AND a.name <> b.name
""",
    "p5_found": """
WITH RECURSIVE ties AS (
  SELECT DISTINCT fact_id AS record_id, merged_into AS via FROM research_assertions WHERE merged_into IS NOT NULL AND fact_id IS NOT NULL
  UNION SELECT DISTINCT task_id, 'component ' || component_id FROM closure3_old_new_heldout WHERE component_id IS NOT NULL),
both_ways AS (SELECT record_id AS u, via AS v FROM ties UNION SELECT via, record_id FROM ties),
reach(u, w) AS (SELECT u, u FROM both_ways UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON e.u = r.w),
records AS (SELECT fact_id AS id FROM research_assertions UNION SELECT task_id FROM closure3_old_new_heldout)
SELECT u AS record_id, min(w) AS group_id FROM reach WHERE u IN (SELECT id FROM records) AND w IN (SELECT id FROM records)
GROUP BY u HAVING count(*) > 1
""",
}
