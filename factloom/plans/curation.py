"""Review, closure, evidence, split and evaluation operators (sections 2.8, 2.9, 2.13 and 2.14), with SQL."""

from __future__ import annotations

from collections.abc import Callable

try:
    import ahocorasick
except ImportError:
    ahocorasick = None
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import evaluation, stats
from factloom.operators.ranks import running
from factloom.plans import analytics, base, competency, relational
from factloom.plans.base import over
from factloom.session import cut, stored, table

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


# 2.8
@add("F-STR-EQUIV", r"SELECT fact_id, lower(replace(subject_name, ' ', '')) = lower(replace(object_name, ' ', '')) OR (length(object_name) >= 2 AND contains(subject_name, object_name)) OR (length(subject_name) >= 2 AND contains(object_name, subject_name)) AS same FROM assertions WHERE subject_name IS NOT NULL AND object_name IS NOT NULL")
def _(s, d):
    a, b, tight = c("subject_name"), c("object_name"), lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("")))
    same = (tight(a) == tight(b)) | ((F.length(b) >= 2) & a.contains(b)) | ((F.length(a) >= 2) & b.contains(a))
    return facts(s, d).filter(a.isNotNull() & b.isNotNull()).select("fact_id", same.alias("same"))


DICTIONARY = 200_000  # names that go to every executor as one automaton; a larger dictionary is joined instead


def longest_names(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, longest): length of the longest dictionary name that stands in a text; texts without one have no row.

    docs: doc_id, text; names: name. A dictionary of DICTIONARY names at most is matched in one pass over each text; beyond
    that, all pieces of the dictionary's lengths are looked up by equality. Null texts and null or empty names don't count.
    """
    names = names.filter("name <> ''").select("name").distinct()
    some = [r[0] for r in names.take(DICTIONARY + 1)]
    texts = docs.filter("text is not null").select("doc_id", "text")
    if len(some) > DICTIONARY or ahocorasick is None:
        lengths = [r[0] for r in names.select(F.length("name")).distinct().collect()]  # as many as names have lengths
        pieces = F.array_distinct(F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i, n=n: F.substring(c("text"), i, F.lit(n))) for n in lengths])))
        found = texts.select("doc_id", F.explode(pieces).alias("name")).join(names, "name")
        return found.groupBy("doc_id").agg(F.max(F.length("name")).cast("long").alias("longest"))

    def run(batches):
        machine = ahocorasick.Automaton()
        for n in some:
            machine.add_word(n, len(n))
        machine.make_automaton()
        for b in batches:
            yield b[["doc_id"]].assign(longest=[max((n for _, n in machine.iter(t)), default=0) for t in b["text"]])

    if not some:
        return texts.select("doc_id", F.lit(0).cast("long").alias("longest")).limit(0)
    return texts.mapInPandas(run, "doc_id long, longest long").filter("longest > 0")


@add("F-STR-LONGEST", "SELECT doc_id, max(length(name)) AS longest FROM documents JOIN (SELECT DISTINCT province AS name FROM assertions WHERE province <> '') ON contains(text, name) GROUP BY 1")
def _(s, d):
    return longest_names(table(s, d, "documents"), facts(s, d).select(c("province").alias("name")))


@add("F-REGEX-CUE", "SELECT doc_id, regexp_matches(text, '(护送|迁至|运输)') AS moves, regexp_matches(text, '(誊录|抄写|翻印)') AS copies FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", c("text").rlike("(护送|迁至|运输)").alias("moves"), c("text").rlike("(誊录|抄写|翻印)").alias("copies"))


@add("F-ATOMIC-NAME", "SELECT entity_id, NOT (canonical_name IN ('群众', '战士', '老乡') OR regexp_matches(canonical_name, '[、,;；]|等$| and ')) AS atomic FROM entities")
def _(s, d):
    n = c("canonical_name")
    return base.entities(s, d).select("entity_id", (~(n.isin("群众", "战士", "老乡") | n.rlike("[、,;；]|等$| and "))).alias("atomic"))


@add("F-REL-CANON", "SELECT fact_id, CASE WHEN predicate = 'raw:协同' AND subject_type = object_type THEN 'allied_with' WHEN predicate = 'raw:路过' AND object_type = 'Place' THEN 'passed_through' WHEN predicate LIKE 'raw:%' THEN 'related_to' ELSE predicate END AS code, CASE WHEN predicate LIKE 'raw:%' THEN 'mapped' ELSE 'exact' END AS strength FROM assertions")
def _(s, d):
    p = c("predicate")
    code = F.when((p == "raw:协同") & (c("subject_type") == c("object_type")), "allied_with").when((p == "raw:路过") & (c("object_type") == "Place"), "passed_through").when(p.like("raw:%"), "related_to").otherwise(p)
    return facts(s, d).select("fact_id", code.alias("code"), F.when(p.like("raw:%"), "mapped").otherwise("exact").alias("strength"))


@add("F-DATE-CLAMP", "SELECT fact_id, least(greatest(start_date, DATE '1910-01-01'), DATE '1960-12-31') AS clamped, last_day(start_date) AS month_end FROM assertions WHERE start_date IS NOT NULL")
def _(s, d):
    low, high = F.lit("1910-01-01").cast("date"), F.lit("1960-12-31").cast("date")
    return facts(s, d).filter("start_date is not null").select("fact_id", F.least(F.greatest("start_date", low), high).alias("clamped"), F.last_day("start_date").alias("month_end"))


@add("F-DATE-YEARS", r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '(1[89]\d{2}|20\d{2})年', 1))) AS years FROM documents WHERE regexp_matches(text, '(1[89]\d{2}|20\d{2})年')")
def _(s, d):
    years = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(1[89]\d{2}|20\d{2})年"), F.lit(1))))
    return table(s, d, "documents").select("doc_id", years.alias("years")).filter(F.size("years") > 0)


@add("F-MAP", "SELECT subject_type, string_agg(research_tier || ':' || n, ',' ORDER BY research_tier) AS counters FROM (SELECT subject_type, research_tier, count(*) AS n FROM assertions GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    n = facts(s, d).groupBy("subject_type", "research_tier").agg(F.count("*").alias("n"))
    return n.groupBy("subject_type").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "research_tier", "n")))).alias("counters"))


# 2.9 review and closure
_CLUSTER = "SELECT canonical_name, count(DISTINCT semantic_entity_type) AS types, min(semantic_entity_type) AS t, min(confidence) AS low FROM entities GROUP BY 1"


@add("D10", f"SELECT canonical_name, CASE WHEN types = 0 THEN 'no_review' WHEN types > 1 THEN 'disagree' WHEN low IS NULL OR low < 0.6 THEN 'low_confidence' ELSE 'accepted' END AS verdict FROM ({_CLUSTER})")
def _(s, d):
    """Accepts a name cluster only if all reviews agree with enough confidence; else a reason."""
    g = base.entities(s, d).groupBy("canonical_name").agg(F.countDistinct("semantic_entity_type").alias("types"), F.min("confidence").alias("low"))
    return g.select("canonical_name", F.when(c("types") == 0, "no_review").when(c("types") > 1, "disagree").when(c("low").isNull() | (c("low") < 0.6), "low_confidence").otherwise("accepted").alias("verdict"))


@add("D11", "SELECT split, count(*) AS n, count(DISTINCT task_id) = count(DISTINCT CASE WHEN action_new IN ('REWRITE', 'RETAIN', 'UNRESOLVED') THEN task_id END) AS partitioned FROM closure3_old_new_heldout GROUP BY 1")
def _(s, d):
    known = F.when(c("action_new").isin("REWRITE", "RETAIN", "UNRESOLVED"), c("task_id"))
    return table(s, d, "closure3_old_new_heldout").groupBy("split").agg(F.count("*").alias("n"), (F.countDistinct("task_id") == F.countDistinct(known)).alias("partitioned"))


@add("D12", "SELECT entity_id, CASE WHEN semantic_entity_type = source_entity_type OR semantic_entity_type IS NULL THEN source_entity_type WHEN source_entity_type = 'Other' THEN semantic_entity_type WHEN semantic_entity_type = 'Other' THEN source_entity_type ELSE 'conflict' END AS kept FROM entities")
def _(s, d):
    a, b = c("semantic_entity_type"), c("source_entity_type")
    return base.entities(s, d).select("entity_id", F.when((a == b) | a.isNull(), b).when(b == "Other", a).when(a == "Other", b).otherwise("conflict").alias("kept"))


_ANCHOR = "CASE WHEN canonical_space_anchor_id IS NULL THEN 'none' WHEN e.entity_id IS NULL THEN 'missing' WHEN e.source_entity_type = 'Place' THEN 'place' WHEN e.source_entity_type = 'Organization' THEN 'seat' WHEN e.source_entity_type = 'Event' THEN 'event_site' ELSE 'other' END"


@add("D19", f"SELECT fact_id, {_ANCHOR} AS anchor_kind FROM assertions a LEFT JOIN entities e ON e.entity_id = canonical_space_anchor_id")
def _(s, d):
    e = base.entities(s, d).select(c("entity_id").alias("canonical_space_anchor_id"), "source_entity_type", F.lit(1).alias("known"))
    t = c("source_entity_type")
    kind = F.when(c("canonical_space_anchor_id").isNull(), "none").when(c("known").isNull(), "missing").when(t == "Place", "place").when(t == "Organization", "seat").when(t == "Event", "event_site").otherwise("other")
    return facts(s, d).select("fact_id", "canonical_space_anchor_id").join(e, "canonical_space_anchor_id", "left").select("fact_id", kind.alias("anchor_kind"))


@add("D14", f"SELECT fact_id, CASE WHEN kind = 'place' THEN 'strict' WHEN kind IN ('seat', 'event_site') THEN 'by_type' WHEN province IS NOT NULL THEN 'gazetteer' ELSE 'unresolved' END AS resolution FROM (SELECT fact_id, province, {_ANCHOR} AS kind FROM assertions a LEFT JOIN entities e ON e.entity_id = canonical_space_anchor_id)")
def _(s, d):
    k = QUERIES["D19"](s, d).join(facts(s, d).select("fact_id", "province"), "fact_id")
    return k.select("fact_id", F.when(c("anchor_kind") == "place", "strict").when(c("anchor_kind").isin("seat", "event_site"), "by_type").when(c("province").isNotNull(), "gazetteer").otherwise("unresolved").alias("resolution"))


@add("D17", "SELECT entity_id, (source_entity_type = 'Person' AND regexp_matches(canonical_name, '(会|社|厂|队|校|院)$')) OR (source_entity_type = 'Organization' AND regexp_matches(canonical_name, '(先生|同志)$')) AS vetoed FROM entities WHERE source_entity_type IS NOT NULL")
def _(s, d):
    t, n = c("source_entity_type"), c("canonical_name")
    return base.entities(s, d).filter(t.isNotNull()).select("entity_id", (((t == "Person") & n.rlike("(会|社|厂|队|校|院)$")) | ((t == "Organization") & n.rlike("(先生|同志)$"))).alias("vetoed"))


@add("D16", "SELECT object_id AS entity_id, CASE WHEN bool_and(predicate = 'occurred_at') THEN 'Event_or_Place' WHEN bool_and(predicate IN ('led', 'trained')) THEN 'Organization' ELSE 'mixed' END AS hint, count(DISTINCT predicate) AS predicates FROM assertions WHERE object_id IS NOT NULL GROUP BY 1")
def _(s, d):
    p = c("predicate")
    hint = F.when(F.bool_and(p == "occurred_at"), "Event_or_Place").when(F.bool_and(p.isin("led", "trained")), "Organization").otherwise("mixed")
    return facts(s, d).filter("object_id is not null").groupBy(c("object_id").alias("entity_id")).agg(hint.alias("hint"), F.countDistinct("predicate").alias("predicates"))


@add("D21", "SELECT fact_id, CASE WHEN canonical_space_anchor_id IS NOT NULL AND province IS NOT NULL THEN 'resolve' WHEN province IS NOT NULL THEN 'raw_only' ELSE 'excluded' END AS plan FROM assertions")
def _(s, d):
    return facts(s, d).select("fact_id", F.when(c("canonical_space_anchor_id").isNotNull() & c("province").isNotNull(), "resolve").when(c("province").isNotNull(), "raw_only").otherwise("excluded").alias("plan"))


@add("D23", "SELECT a.fact_id, CASE WHEN a.time_role = 'event_occurrence' AND coalesce(e.source_entity_type, '') <> 'Event' THEN 'context_time' ELSE a.time_role END AS time_role FROM assertions a LEFT JOIN entities e ON e.entity_id = a.subject_id")
def _(s, d):
    """Time roles checked again after identities have merged: without an event as owner they fall back to context."""
    e = base.entities(s, d).select(c("entity_id").alias("subject_id"), c("source_entity_type").alias("t"))
    a = facts(s, d).select("fact_id", "subject_id", "time_role").join(e, "subject_id", "left")
    return a.select("fact_id", F.when((c("time_role") == "event_occurrence") & (F.coalesce("t", F.lit("")) != "Event"), "context_time").otherwise(c("time_role")).alias("time_role"))


FORMS = {"CreativeWork": "CreativeNarrative", "Event": "HistoricalPractice", "Concept": "SpiritValue", "Organization": "InstitutionalPractice", "Place": "MaterialCulture"}
_FORMS = ", ".join(f"('{k}', '{v}')" for k, v in FORMS.items())


@add("D32", f"SELECT e.entity_id, f.form, 'direct_type' AS rule FROM entities e JOIN (VALUES {_FORMS}) f(t, form) ON t = source_entity_type UNION SELECT object_id, 'MemoryTransmission', 'relation' FROM assertions WHERE predicate = 'commemorates' AND object_id IS NOT NULL")
def _(s, d):
    """Cultural forms by type and by relation."""
    form = F.create_map(*[F.lit(x) for kv in FORMS.items() for x in kv])[c("source_entity_type")]
    direct = base.entities(s, d).select("entity_id", form.alias("form"), F.lit("direct_type").alias("rule")).filter("form is not null")
    rel = facts(s, d).filter("predicate = 'commemorates' and object_id is not null").select(c("object_id").alias("entity_id"), F.lit("MemoryTransmission").alias("form"), F.lit("relation").alias("rule"))
    return direct.union(rel).distinct()


@add("D40", "SELECT DISTINCT u.state_id, counterpart_id AS actor_id, role_code FROM state_support u JOIN roles r ON r.fact_id = u.fact_id WHERE counterpart_id IS NOT NULL")
def _(s, d):
    return base.state_support(s, d).select("state_id", "fact_id").distinct().join(base.roles(s, d), "fact_id").filter("counterpart_id is not null").select("state_id", c("counterpart_id").alias("actor_id"), "role_code").distinct()


@add("D47", "SELECT DISTINCT s.state_id, a.object_id AS facet_id FROM states s JOIN assertions a ON a.subject_id = s.culture_subject_id WHERE a.object_type = 'Concept' AND a.object_id IS NOT NULL")
def _(s, d):
    f = facts(s, d).filter("object_type = 'Concept' and object_id is not null").select(c("subject_id").alias("culture_subject_id"), c("object_id").alias("facet_id"))
    return base.states(s, d).select("state_id", "culture_subject_id").join(f, "culture_subject_id").select("state_id", "facet_id").distinct()


@add("D48", "SELECT canonical_name, CASE count(DISTINCT semantic_family) WHEN 0 THEN 'unknown' WHEN 1 THEN min(semantic_family) ELSE 'conflict' END AS family FROM entities GROUP BY 1")
def _(s, d):
    n = F.countDistinct("semantic_family")
    return base.entities(s, d).groupBy("canonical_name").agg(F.when(n == 0, "unknown").when(n == 1, F.min("semantic_family")).otherwise("conflict").alias("family"))


@add("D49", "SELECT entity_id, CASE WHEN coalesce(confidence, 0) < 0.9 THEN 'unknown' ELSE semantic_entity_type END AS label FROM entities")
def _(s, d):
    return base.entities(s, d).select("entity_id", F.when(F.coalesce("confidence", F.lit(0.0)) < 0.9, "unknown").otherwise(c("semantic_entity_type")).alias("label"))


@add("D52", "SELECT s.state_id, coalesce(t.a, x.a, stage_start) AS interval_start, coalesce(t.b, x.b, stage_end) AS interval_end, CASE WHEN t.a IS NOT NULL THEN 'trusted' WHEN x.a IS NOT NULL THEN 'asserted' ELSE 'stage' END AS basis FROM states s JOIN stages g ON g.stage_order = s.stage_order LEFT JOIN (SELECT state_id, min(start_date) AS a, max(end_date) AS b FROM (SELECT DISTINCT state_id, fact_id FROM state_support) u JOIN assertions a ON a.fact_id = u.fact_id WHERE start_date <= end_date AND research_tier = 'strict_semantic' GROUP BY 1) t ON t.state_id = s.state_id LEFT JOIN (SELECT state_id, min(start_date) AS a, max(end_date) AS b FROM (SELECT DISTINCT state_id, fact_id FROM state_support) u JOIN assertions a ON a.fact_id = u.fact_id WHERE start_date <= end_date GROUP BY 1) x ON x.state_id = s.state_id")
def _(s, d):
    """A state's interval from its trusted facts, else from any dated facts, else from its stage; one aggregation."""
    f = facts(s, d).filter("start_date <= end_date").select("fact_id", "start_date", "end_date", (c("research_tier") == "strict_semantic").alias("sure"))
    u = base.state_support(s, d).select("state_id", "fact_id").distinct().join(f, "fact_id")
    g = u.groupBy("state_id").agg(F.min(F.when(c("sure"), c("start_date"))).alias("ta"), F.max(F.when(c("sure"), c("end_date"))).alias("tb"), F.min("start_date").alias("xa"), F.max("end_date").alias("xb"))
    rows = base.states(s, d).select("state_id", "stage_order").join(g, "state_id", "left").join(base.stages(s, d).select("stage_order", "stage_start", "stage_end"), "stage_order")
    return rows.select("state_id", F.coalesce("ta", "xa", "stage_start").alias("interval_start"), F.coalesce("tb", "xb", "stage_end").alias("interval_end"), F.when(c("ta").isNotNull(), "trusted").when(c("xa").isNotNull(), "asserted").otherwise("stage").alias("basis"))


@add("D55", "SELECT task_id, max(CASE WHEN type = 'unknown→event_occurrence' AND action_new = 'REWRITE' THEN 1 ELSE 0 END) AS applied FROM closure3_old_new_heldout WHERE task_id IS NOT NULL GROUP BY 1")
def _(s, d):
    """Applies only classes marked for rewriting."""
    hit = F.when((c("type") == "unknown→event_occurrence") & (c("action_new") == "REWRITE"), 1).otherwise(0)
    return table(s, d, "closure3_old_new_heldout").filter("task_id is not null").groupBy("task_id").agg(F.max(hit).alias("applied"))


def provenance_alignment(facts: DataFrame, evidence: DataFrame, texts: int = 3) -> DataFrame:
    """(fact_id, alignment): aligned if the subject's or object's name (two signs or more) stands in one of the fact's first
    texts by rank, mismatch_with_evidence if not, no_evidence without a text. evidence: fact_id, rank, text.

    The first texts are picked before the shuffle already (a limit per window group), so that a fact with a third of all
    texts stays small. Names are trimmed; null names never hit, empty texts are no texts.
    """
    place = F.row_number().over(W.partitionBy("fact_id").orderBy("rank"))
    first = evidence.filter("fact_id is not null and text <> ''").withColumn("place", place).filter(c("place") <= texts)
    kept = first.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("first"))
    hit = lambda k: F.coalesce((F.length(F.trim(k)) >= 2) & F.contains("joined", F.trim(k)), F.lit(False))
    rows = facts.select("fact_id", "subject_name", "object_name").join(kept, "fact_id", "left").withColumn("joined", F.array_join("first", "\n"))
    verdict = F.when(c("joined").isNull(), "no_evidence").when(hit("subject_name") | hit("object_name"), "aligned").otherwise("mismatch_with_evidence")
    return rows.select("fact_id", verdict.alias("alignment"))


_TEXTS = "SELECT fact_id, concat_ws(' ', event_name, counterpart_name) AS text, event_id || chr(31) || coalesce(event_endpoint, '') AS rank FROM links"


@add("D58", f"SELECT a.fact_id, CASE WHEN joined IS NULL THEN 'no_evidence' WHEN (length(trim(subject_name)) >= 2 AND contains(joined, trim(subject_name))) OR (length(trim(object_name)) >= 2 AND contains(joined, trim(object_name))) THEN 'aligned' ELSE 'mismatch_with_evidence' END AS alignment FROM assertions a LEFT JOIN (SELECT fact_id, string_agg(text, chr(10) ORDER BY rank) AS joined FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY rank) AS r FROM ({_TEXTS}) WHERE text <> '') WHERE r <= 3 GROUP BY 1) l ON l.fact_id = a.fact_id WHERE research_tier = 'strict_semantic'")
def _(s, d):
    """The tables have no evidence texts; the names that a fact's event links carry stand in for them."""
    text = base.links(s, d).select("fact_id", F.concat_ws(" ", "event_name", "counterpart_name").alias("text"), F.concat_ws("\x1f", "event_id", F.coalesce("event_endpoint", F.lit(""))).alias("rank"))
    return provenance_alignment(facts(s, d).filter("research_tier = 'strict_semantic'"), text)


@add("D59", "SELECT a.fact_id, CASE WHEN c.fact_id IS NOT NULL THEN 'A' WHEN l.fact_id IS NOT NULL THEN 'B' WHEN m.fact_id IS NOT NULL THEN 'C' ELSE 'D' END AS level FROM assertions a LEFT JOIN (SELECT DISTINCT fact_id FROM cell_support) c ON c.fact_id = a.fact_id LEFT JOIN (SELECT DISTINCT fact_id FROM links) l ON l.fact_id = a.fact_id LEFT JOIN (SELECT DISTINCT merged_into AS fact_id FROM assertions) m ON m.fact_id = a.fact_id")
def _(s, d):
    """The evidence cascade: direct support, event links, merged siblings, none; sources meet in one grouping."""
    tag = lambda df, k, n: df.select(c(k).alias("fact_id"), F.lit(n).alias("level")).dropna()
    a = facts(s, d)
    found = tag(base.cell_support(s, d), "fact_id", "A").union(tag(base.links(s, d), "fact_id", "B")).union(tag(a, "merged_into", "C")).groupBy("fact_id").agg(F.min("level").alias("level"))
    return a.select("fact_id").join(found, "fact_id", "left").na.fill("D", ["level"])


INDEX_BUCKETS = 64


def text_index(s, d) -> DataFrame:
    """(bucket, gram, doc_id): all pairs of neighbouring signs of all texts, and lone signs of texts of one sign; built once
    and laid out by bucket of the gram, so that a search reads its grams' buckets only."""
    t = table(s, d, "documents").filter("text <> ''").select("doc_id", "text")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substring(c("text"), i, F.lit(2)))
    build = lambda: t.select("doc_id", F.explode(F.array_distinct(grams)).alias("gram")).withColumn("bucket", _bucket(c("gram"))).repartition("bucket").sortWithinPartitions("bucket", "gram")
    return stored(s, d, "text_index", ["documents"], build, "bucket")


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(INDEX_BUCKETS)).cast("int")


def search_texts(s, d, term: str) -> DataFrame:
    """(doc_id) of the texts that hold a term of two signs or more: postings of all its grams, then containment."""
    if len(term) < 2:
        raise ValueError("a term needs two signs")
    grams = sorted({term[i : i + 2] for i in range(len(term) - 1)})
    buckets = [r[0] for r in s.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(c("gram"))).distinct().collect()]
    hits = text_index(s, d).filter(c("bucket").isin(buckets) & c("gram").isin(grams)).groupBy("doc_id").agg(F.count("*").alias("n")).filter(c("n") == len(grams))
    return table(s, d, "documents").select("doc_id", "text").join(hits.select("doc_id"), "doc_id", "left_semi").filter(c("text").contains(term)).select("doc_id")


@add("D60", "SELECT doc_id FROM documents WHERE contains(text, '油印小报')")
def _(s, d, term="油印小报"):
    return search_texts(s, d, term)


@add("D62", "SELECT fact_id, CASE WHEN n >= 3 THEN 'many' WHEN n = 2 THEN 'two' ELSE 'one' END AS support, n FROM (SELECT fact_id, count(*) AS n FROM cell_support GROUP BY 1)")
def _(s, d):
    n = base.cell_support(s, d).groupBy("fact_id").agg(F.count("*").alias("n"))
    return n.select("fact_id", X.bin_of(c("n"), [1, 2], ["one", "two", "many"]).alias("support"), "n")


@add("D63", "SELECT type, action_new, count(*) AS support, sum((new_outcome LIKE '%CORRECT')::INTEGER)::BIGINT AS hits FROM closure3_old_new_heldout GROUP BY 1, 2 HAVING count(*) >= 20")
def _(s, d):
    """Rules as conjunctions of atoms with their support and hits."""
    g = table(s, d, "closure3_old_new_heldout").groupBy("type", "action_new").agg(F.count("*").alias("support"), F.sum(c("new_outcome").like("%CORRECT").cast("int")).alias("hits"))
    return g.filter("support >= 20")


@add("D65", "SELECT fact_id, CASE WHEN n IS NULL THEN 'no_evidence' WHEN risk_tier = 'A' AND n >= 2 THEN 'trusted' WHEN risk_tier IN ('A', 'B') THEN 'asserted' ELSE 'hold' END AS final_tier FROM (SELECT a.fact_id, risk_tier, n FROM assertions a LEFT JOIN (SELECT fact_id, count(*) AS n FROM cell_support GROUP BY 1) c ON c.fact_id = a.fact_id)")
def _(s, d):
    n = base.cell_support(s, d).groupBy("fact_id").agg(F.count("*").alias("n"))
    a = facts(s, d).select("fact_id", "risk_tier").join(n, "fact_id", "left")
    return a.select("fact_id", F.when(c("n").isNull(), "no_evidence").when((c("risk_tier") == "A") & (c("n") >= 2), "trusted").when(c("risk_tier").isin("A", "B"), "asserted").otherwise("hold").alias("final_tier"))


QUERIES["D68"], SQL["D68"] = (lambda s, d: QUERIES["D65"](s, d).groupBy("final_tier").agg(F.count("*").alias("n"))), f"SELECT final_tier, count(*) AS n FROM ({SQL['D65']}) GROUP BY 1"


@add("D66", "SELECT fact_id, row_number() OVER (PARTITION BY predicate ORDER BY CASE risk_tier WHEN 'D' THEN 0 WHEN 'C' THEN 1 WHEN 'B' THEN 2 ELSE 3 END, confidence NULLS FIRST, fact_id) AS place FROM assertions WHERE semantic_status = 'pending'")
def _(s, d):
    order = [F.when(c("risk_tier") == "D", 0).when(c("risk_tier") == "C", 1).when(c("risk_tier") == "B", 2).otherwise(3), F.asc_nulls_first("confidence"), "fact_id"]
    rows = facts(s, d).filter("semantic_status = 'pending'").select("fact_id", "predicate", "confidence", order[0].alias("rank"))
    return running(rows, ["predicate"], [c("rank"), order[1], c("fact_id")]).select("fact_id", c("__place").alias("place"))


@add("D67", "SELECT fact_id, concat_ws(',', CASE WHEN start_date IS NULL THEN 'no_time' END, CASE WHEN province IS NULL THEN 'no_place' END, CASE WHEN research_tier = 'unresolved' THEN 'unresolved' END, CASE WHEN merged_into IS NOT NULL THEN 'merged' END) AS blockers FROM assertions")
def _(s, d):
    why = {"no_time": c("start_date").isNull(), "no_place": c("province").isNull(), "unresolved": c("research_tier") == "unresolved", "merged": c("merged_into").isNotNull()}
    return facts(s, d).select("fact_id", F.concat_ws(",", *[F.when(x, k) for k, x in why.items()]).alias("blockers"))


@add("D70", "SELECT fact_id, CASE WHEN province IN (SELECT province FROM (SELECT province, row_number() OVER (ORDER BY count(*), province) AS r, count(*) OVER () AS n FROM assertions WHERE province IS NOT NULL GROUP BY 1) WHERE r <= n // 2) THEN 'heldout' ELSE 'train' END AS split FROM assertions")
def _(s, d):
    """Provinces up to the median by size are held out; there are few provinces."""
    n = facts(s, d).filter("province is not null").groupBy("province").agg(F.count("*").alias("k"))
    ranked = n.select("province", F.row_number().over(W.orderBy("k", "province")).alias("r"), F.count("*").over(W.partitionBy()).alias("n"))
    out = ranked.filter(c("r") <= F.floor(c("n") / 2)).select("province", F.lit("heldout").alias("split"))
    return facts(s, d).select("fact_id", "province").join(out, "province", "left").na.fill("train", ["split"]).select("fact_id", "split")


@add("D71", "WITH n AS (SELECT predicate, count(*) AS k FROM assertions GROUP BY 1), q AS (SELECT predicate, 100.0 * k / sum(k) OVER () AS x FROM n), f AS (SELECT predicate, floor(x)::BIGINT AS base, row_number() OVER (ORDER BY x - floor(x) DESC, predicate) AS r, 100 - sum(floor(x)) OVER () AS rest FROM q) SELECT predicate, base + (r <= rest)::BIGINT AS quota FROM f")
def _(s, d, size=100):
    """Largest-remainder allocation of a sample over strata."""
    n = facts(s, d).groupBy("predicate").agg(F.count("*").alias("k"))
    x = n.withColumn("x", size * c("k") / F.sum("k").over(W.partitionBy()))
    f = x.select("predicate", F.floor("x").alias("base"), F.row_number().over(W.orderBy((c("x") - F.floor("x")).desc(), "predicate")).alias("r"), (size - F.sum(F.floor("x")).over(W.partitionBy())).alias("rest"))
    return f.select("predicate", (c("base") + (c("r") <= c("rest")).cast("long")).alias("quota"))


SQL["D71"] = SQL["D71"].replace("\nWITH n AS", ", n AS")


@add("D73", "SELECT (SELECT count(*) FROM (SELECT task_id FROM closure3_old_new_heldout WHERE split = 'learn' INTERSECT SELECT task_id FROM closure3_old_new_heldout WHERE split = 'heldout')) AS shared_tasks, (SELECT count(*) FROM (SELECT component_id FROM closure3_old_new_heldout WHERE split = 'learn' AND component_id IS NOT NULL INTERSECT SELECT component_id FROM closure3_old_new_heldout WHERE split = 'heldout')) AS shared_components")
def _(s, d):
    """Leakage between splits, by task and by component."""
    t = table(s, d, "closure3_old_new_heldout")
    shared = lambda k: t.filter(c(k).isNotNull()).groupBy(k).agg(F.countDistinct(F.when(c("split").isin("learn", "heldout"), c("split"))).alias("n")).agg(F.count(F.when(c("n") == 2, 1)).alias("n"))
    return shared("task_id").select(c("n").alias("shared_tasks")).join(F.broadcast(shared("component_id").select(c("n").alias("shared_components"))))


@add("D81", "SELECT event_id, regexp_matches(props, '\"(gold|label|answer)\"') AS leaks FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", c("props").rlike('"(gold|label|answer)"').alias("leaks"))


@add("D83", "SELECT page_id, lower(name) AS k, count(DISTINCT vote) AS votes FROM (SELECT page_id, vote, unnest(parsed.entities).name AS name FROM page001_5_35 WHERE parsed IS NOT NULL) WHERE name IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    """Lists of several passes merged by key, one vote per pass."""
    e = table(s, d, "page001_5_35").filter("parsed is not null").select("page_id", "vote", F.explode("parsed.entities.name").alias("name")).dropna()
    return e.groupBy("page_id", F.lower("name").alias("k")).agg(F.countDistinct("vote").alias("votes"))


AUDIT_GROUPS = {"BEFORE_BETTER": "one", "AFTER_BETTER": "one", "BOTH_WRONG": "none", "INSUFFICIENT_EVIDENCE": "open"}
_GROUP = lambda k: f"CASE WHEN {k} IN ('BEFORE_BETTER', 'AFTER_BETTER') THEN 'one' WHEN {k} = 'BOTH_WRONG' THEN 'none' ELSE 'open' END"


def dual_audit(ballots: DataFrame, tiers: DataFrame) -> DataFrame:
    """(tier, n, equal, same_group, different, supported, unsupported): two raters' verdicts by tier.

    ballots: item, rater, label; the two smallest raters of an item count, items of one rater don't. Support is counted
    on the items where both say the same. tiers: item, tier; items without one are 'none'.
    """
    place = F.row_number().over(W.partitionBy("item").orderBy("rater"))
    first = ballots.withColumn("place", place).filter("place <= 2").groupBy("item")
    two = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("ab")).filter("size(ab) = 2")
    of = F.create_map(*[F.lit(x) for kv in AUDIT_GROUPS.items() for x in kv])
    a, b = c("ab")[0], c("ab")[1]
    rows = two.join(tiers, "item", "left").select(F.coalesce("tier", F.lit("none")).alias("tier"), (a == b).alias("same"), (of[a] == of[b]).alias("near"), of[a].alias("g"))
    n = lambda x: F.count(F.when(x, 1))
    return rows.groupBy("tier").agg(
        F.count("*").alias("n"), n(c("same")).alias("equal"), n(~c("same") & c("near")).alias("same_group"), n(~c("near")).alias("different"),
        n(c("same") & (c("g") == "one")).alias("supported"), n(c("same") & (c("g") == "none")).alias("unsupported"),
    )


@add("D84", f"WITH v AS (SELECT item, label, row_number() OVER (PARTITION BY item ORDER BY rater) AS r FROM {analytics._V}), p AS (SELECT x.item, x.label AS a, y.label AS b FROM v x JOIN v y ON y.item = x.item AND y.r = 2 WHERE x.r = 1), t AS (SELECT task_id, max(consensus_tier) AS tier FROM closure3_old_new_heldout WHERE task_id IS NOT NULL GROUP BY 1) SELECT coalesce(tier, 'none') AS tier, count(*) AS n, count(*) FILTER (a = b) AS equal, count(*) FILTER (a <> b AND {_GROUP('a')} = {_GROUP('b')}) AS same_group, count(*) FILTER ({_GROUP('a')} <> {_GROUP('b')}) AS different, count(*) FILTER (a = b AND {_GROUP('a')} = 'one') AS supported, count(*) FILTER (a = b AND {_GROUP('a')} = 'none') AS unsupported FROM p LEFT JOIN t ON t.task_id = p.item GROUP BY 1")
def _(s, d):
    tiers = table(s, d, "closure3_old_new_heldout").filter("task_id is not null").groupBy(c("task_id").alias("item")).agg(F.max("consensus_tier").alias("tier"))
    return dual_audit(analytics._ballots(s, d), tiers)


SQL["D84"] = SQL["D84"].replace("\nWITH v AS", ", v AS")


# 2.13
@add("G-SEARCH-FT", "SELECT entity_id, rank FROM (SELECT entity_id, CASE WHEN lower(canonical_name) = 'night' THEN 0 WHEN starts_with(lower(canonical_name), 'night') THEN 1 ELSE 2 END AS rank, canonical_name FROM entities WHERE contains(lower(canonical_name), 'night')) ORDER BY rank, length(canonical_name), entity_id LIMIT 20")
def _(s, d, q="night"):
    """Exact before prefix before containment, then shorter, then by id; the top 20."""
    n = F.lower("canonical_name")
    rank = F.when(n == q, 0).when(n.startswith(q), 1).otherwise(2)
    return base.entities(s, d).filter(n.contains(q)).select("entity_id", "canonical_name", rank.alias("rank")).orderBy("rank", F.length("canonical_name"), "entity_id").limit(20).select("entity_id", "rank")


@add("H-TIMELINE", "SELECT a.fact_id, a.subject_id, start_date, end_date, event_name FROM assertions a LEFT JOIN frames f ON f.event_id = a.subject_id WHERE start_date IS NOT NULL")
def _(s, d):
    f = base.frames(s, d).select(c("event_id").alias("subject_id"), "event_name")
    return facts(s, d).filter("start_date is not null").select("fact_id", "subject_id", "start_date", "end_date").join(f, "subject_id", "left").orderBy("subject_id", "start_date", "fact_id")


# 2.14
_T = "(SELECT task_id, max(correct_old) AS a, max(correct_new) AS b FROM closure3_old_new_heldout WHERE task_id IS NOT NULL GROUP BY 1)"


def _paired(s, d) -> DataFrame:
    return table(s, d, "closure3_old_new_heldout").filter("task_id is not null").groupBy("task_id").agg(F.max("correct_old").alias("a"), F.max("correct_new").alias("b"))


@add("M-MCNEMAR", f"SELECT sum((a = 1 AND b = 0)::INTEGER)::BIGINT AS only_old, sum((a = 0 AND b = 1)::INTEGER)::BIGINT AS only_new, round((abs(sum((a = 1 AND b = 0)::INTEGER) - sum((a = 0 AND b = 1)::INTEGER)) - 1) * (abs(sum((a = 1 AND b = 0)::INTEGER) - sum((a = 0 AND b = 1)::INTEGER)) - 1) / (sum((a = 1 AND b = 0)::INTEGER) + sum((a = 0 AND b = 1)::INTEGER))::DOUBLE, 6) AS chi2 FROM {_T} WHERE a IS NOT NULL AND b IS NOT NULL")
def _(s, d):
    """M-MCNEMAR-JOINT too: only tasks that both sides decided."""
    p = _paired(s, d).filter("a is not null and b is not null")
    g = p.agg(F.sum(((c("a") == 1) & (c("b") == 0)).cast("int")).alias("only_old"), F.sum(((c("a") == 0) & (c("b") == 1)).cast("int")).alias("only_new"))
    k = F.abs(c("only_old") - c("only_new")) - 1
    return g.withColumn("chi2", F.round(k * k / (c("only_old") + c("only_new")), 6))


@add("M-MCNEMAR-JOINT", f"SELECT x AS only_old, y AS only_new, CASE WHEN x + y = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))) FROM (SELECT unnest(range(0, least(x, y) + 1)) AS i))), 6) END AS p_value FROM (SELECT count(*) FILTER (a = 1 AND b = 0) AS x, count(*) FILTER (a = 0 AND b = 1) AS y FROM {_T} WHERE a IS NOT NULL AND b IS NOT NULL)")
def _(s, d):
    """The exact test over tasks that both sides decided; 1 without a task on which they differ. One row comes to the driver."""
    p = _paired(s, d).filter("a is not null and b is not null")
    x, y = p.agg(F.count(F.when((c("a") == 1) & (c("b") == 0), 1)), F.count(F.when((c("a") == 0) & (c("b") == 1), 1))).first()
    return s.createDataFrame([(x, y, round(stats.binomial_two_sided(x, y), 6))], "only_old long, only_new long, p_value double")


_BOUND = "({p} + 1.959963984540054 * 1.959963984540054 / (2 * {n}) {sign} 1.959963984540054 * sqrt({p} * (1 - {p}) / {n} + 1.959963984540054 * 1.959963984540054 / (4 * {n} * {n}))) / (1 + 1.959963984540054 * 1.959963984540054 / {n})"
_ENDS = ", ".join(f"{_BOUND.format(p=f'p{k}', n=f'n{k}', sign=sign)} AS {name}{k}" for k in (1, 2) for sign, name in (("-", "l"), ("+", "u")))


@add("M-NEWCOMBE", f"SELECT round(p1 - p2, 6) AS difference, round(p1 - p2 - sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2)), 6) AS low, round(p1 - p2 + sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2)), 6) AS high FROM (SELECT *, {_ENDS} FROM (SELECT sum(a)::DOUBLE / count(a) AS p1, count(a)::DOUBLE AS n1, sum(b)::DOUBLE / count(b) AS p2, count(b)::DOUBLE AS n2 FROM {_T}))")
def _(s, d):
    p = _paired(s, d).agg(F.sum("a").alias("ka"), F.count("a").alias("na"), F.sum("b").alias("kb"), F.count("b").alias("nb"))
    low, high = stats.newcombe(c("ka"), c("na"), c("kb"), c("nb"))
    return p.select(F.round(c("ka") / c("na") - c("kb") / c("nb"), 6).alias("difference"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@add("M-BOOTSTRAP")
def _(s, d):
    """Percentile interval of each method's mean; the methods are few."""
    counts = cut(analytics.runs(s, d).groupBy("method", "correct").agg(F.count("*").alias("n")))
    out = []
    for m in sorted(r[0] for r in counts.select("method").distinct().collect()):
        low, high = evaluation.bootstrap(counts.filter(c("method") == m), evaluation.mean_of, "correct")
        out.append((m, round(low, 6), round(high, 6)))
    return s.createDataFrame(out, "method string, low double, high double")


def _difference(s, d) -> DataFrame:
    """Tasks that both sides decided, by type and by the new side's gain: -1, 0 or 1."""
    t = table(s, d, "closure3_old_new_heldout").filter("task_id is not null").groupBy("task_id").agg(F.max("correct_old").cast("int").alias("a"), F.max("correct_new").cast("int").alias("b"), F.max("type").alias("type"))
    return t.dropna(subset=["a", "b"]).groupBy("type", (c("b") - c("a")).alias("gain")).agg(F.count("*").alias("n"))


def _interval(s, bounds) -> DataFrame:
    return s.createDataFrame([tuple(round(x, 6) for x in bounds)] if bounds else [], "low double, high double")


@add("M-BOOTSTRAP-PAIRED")
def _(s, d):
    """Interval of the mean gain of new over old, tasks drawn as pairs."""
    return _interval(s, evaluation.bootstrap(_difference(s, d).groupBy("gain").agg(F.sum("n").alias("n")), evaluation.mean_of, "gain"))


@add("M-BOOTSTRAP-STRATIFIED")
def _(s, d):
    """The same with the types of tasks as strata of fixed sizes; types are few."""
    return _interval(s, evaluation.bootstrap(_difference(s, d), evaluation.mean_of, "gain", "type"))


@add("M-COHEN", f"WITH p AS (SELECT a, b, count(*)::DOUBLE AS n FROM {_T} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(n) AS t, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM p), e AS (SELECT sum(x.n * y.n) AS c FROM (SELECT a AS l, sum(n) AS n FROM p GROUP BY 1) x JOIN (SELECT b AS l, sum(n) AS n FROM p GROUP BY 1) y ON x.l = y.l) SELECT round((same / t - c / (t * t)) / (1 - c / (t * t)), 9) AS kappa FROM t, e")
def _(s, d):
    p = _paired(s, d).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))
    return stats.cohen_kappa(p).select(F.round("kappa", 9).alias("kappa"))


@add("M-RISK@COV", f"SELECT method, round(min(risk), 9) AS least_risk FROM ({analytics._CURVE}) WHERE coverage > 0 AND coverage <= 0.5 + 1e-12 GROUP BY 1")
def _(s, d):
    return stats.risk_coverage(analytics.runs(s, d), ["method"]).filter("coverage > 0 and coverage <= 0.5 + 1e-12").groupBy("method").agg(F.round(F.min("risk"), 9).alias("least_risk"))


@add("M-NEAREST-RISK", f"SELECT method, round(arg_min(risk, abs(coverage - 0.3) * 1e6 - coverage / 1e3), 9) AS risk FROM ({analytics._CURVE}) GROUP BY 1")
def _(s, d):
    curve = stats.risk_coverage(analytics.runs(s, d), ["method"])
    return curve.groupBy("method").agg(F.round(F.min_by("risk", F.abs(c("coverage") - 0.3) * 1e6 - c("coverage") / 1e3), 9).alias("risk"))


@add("M-UTILITY", f"SELECT method, t, round(avg(a * correct) - avg(a * (1 - correct)) - 0.5 * avg((a = 1 AND NOT gate)::INTEGER), 9) AS utility FROM (SELECT r.*, t, (score >= t)::INTEGER AS a FROM ({analytics._RUN}) r, (SELECT unnest(range(1, 21))::DOUBLE / 20 AS t)) GROUP BY 1, 2")
def _(s, d):
    """Utility over a grid of thresholds: rows carry the grid as an array of 20."""
    rows = analytics.runs(s, d).select("method", "score", "correct", "gate", F.explode(F.array(*[F.lit(i / 20) for i in range(1, 21)])).alias("t"))
    a = (c("score") >= c("t")).cast("int")
    return rows.groupBy("method", "t").agg(F.round(F.avg(a * c("correct")) - F.avg(a * (1 - c("correct"))) - 0.5 * F.avg(((a == 1) & ~c("gate")).cast("int")), 9).alias("utility"))


@add("M-ROUTE-3WAY", f"SELECT method, CASE WHEN score >= 0.8 THEN 'accept' WHEN score >= 0.4 THEN 'review' ELSE 'reject' END AS route, count(*) AS n, sum(correct)::BIGINT AS correct FROM ({analytics._RUN}) GROUP BY 1, 2")
def _(s, d):
    route = F.when(c("score") >= 0.8, "accept").when(c("score") >= 0.4, "review").otherwise("reject")
    return analytics.runs(s, d).groupBy("method", route.alias("route")).agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))


@add("M-BUDGET-METRICS", f"SELECT method, b, sum(1 - correct)::BIGINT AS caught FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score, event_id) AS r, count(*) OVER (PARTITION BY method) AS n FROM ({analytics._RUN})), (VALUES (0.05), (0.1), (0.2)) v(b) WHERE r <= floor(b * n + 0.5) GROUP BY 1, 2")
def _(s, d):
    rows = running(analytics.runs(s, d).select("method", "correct", "score", "event_id"), ["method"], [c("score"), c("event_id")], totals=True).select("method", "correct", c("__place").alias("r"), c("__n").alias("n"))
    at = rows.select("*", F.explode(F.array(*[F.lit(b) for b in (0.05, 0.1, 0.2)])).alias("b")).filter(c("r") <= F.floor(c("b") * c("n") + 0.5))
    return at.groupBy("method", "b").agg(F.sum(1 - c("correct")).alias("caught"))


def class_gate(rows: DataFrame, by: list[str], min_support: int = 50, min_precision: float = 0.98, min_wilson: float = 0.95, steps: int = 20) -> DataFrame:
    """(by, threshold): the lowest threshold of a grid that has the support, the precision and Wilson's lower bound.

    rows: by, score, correct (0 or 1). Groups without such a threshold have no row. The counts of the grid's cells are
    aggregated first, so that a row isn't copied once a threshold.
    """
    cell = F.least(F.floor(c("score") * steps + 1e-9), F.lit(steps - 1)).cast("int")
    at = rows.filter("score >= 0").groupBy(*by, cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    up = at.select(*by, "n", "k", F.explode(F.sequence(F.lit(0), "cell")).alias("step")).groupBy(*by, "step").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    low, _ = stats.wilson(c("k"), c("n"))
    good = up.filter((c("n") >= min_support) & (c("k") / c("n") >= min_precision) & (low >= min_wilson))
    return good.groupBy(*by).agg((F.min("step") / steps).alias("threshold"))


_WILSON = "(k / n + 1.959963984540054 * 1.959963984540054 / (2 * n) - 1.959963984540054 * sqrt((k / n * (1 - k / n) + 1.959963984540054 * 1.959963984540054 / (4 * n)) / n)) / (1 + 1.959963984540054 * 1.959963984540054 / n)"


@add("M-CLASS-GATE", f"SELECT method, min(t) AS threshold FROM (SELECT method, t, count(*)::DOUBLE AS n, sum(correct)::DOUBLE AS k FROM ({analytics._RUN}) r, (SELECT unnest(range(0, 20))::DOUBLE / 20 AS t) g WHERE score >= t GROUP BY 1, 2) WHERE n >= 50 AND k / n >= 0.98 AND {_WILSON} >= 0.95 GROUP BY 1")
def _(s, d):
    return class_gate(analytics.runs(s, d).select("method", "score", "correct"), ["method"])


_BALLOTS = analytics._V
_TOP = "arg_min(label, (-n, label))"


@add("M-LOO-JUDGE", f"WITH v AS (SELECT * FROM {_BALLOTS}), j AS (SELECT DISTINCT rater AS left_out FROM v), n AS (SELECT left_out, item, label, count(*) AS n FROM v, j WHERE rater <> left_out GROUP BY 1, 2, 3), t AS (SELECT left_out, item, label FROM (SELECT *, row_number() OVER (PARTITION BY left_out, item ORDER BY n DESC, label) AS r FROM n) WHERE r = 1), w AS (SELECT item, label FROM (SELECT item, label, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, label) AS r FROM v GROUP BY 1, 2) WHERE r = 1) SELECT left_out, round(avg((t.label = w.label)::INTEGER), 6) AS unchanged FROM t JOIN w ON w.item = t.item GROUP BY 1")
def _(s, d):
    """Share of items whose plurality stays with each rater left out in turn. An item that a rater didn't vote on stays as
    it is, so each vote is looked at once: the rater's own vote is taken off the item's counts by label."""
    v = cut(analytics._ballots(s, d))
    counts = v.groupBy("item", "label").agg(F.count("*").alias("n"))
    of_item = counts.groupBy("item").agg(F.collect_list(F.struct((-c("n")).alias("n"), "label")).alias("all"))  # one entry per label
    mine = v.join(of_item, "item").withColumn("mine", c("label"))
    left = F.filter(F.transform("all", lambda x: F.struct((x["n"] + (x["label"] == c("mine")).cast("int")).alias("n"), x["label"].alias("label"))), lambda x: x["n"] < 0)
    seen = mine.select("rater", F.array_min("all")["label"].alias("whole"), F.array_min(left)["label"].alias("rest"))
    per = seen.groupBy(c("rater").alias("left_out")).agg(F.count(F.when(c("rest").isNull(), 1)).alias("gone"), F.count(F.when(c("rest") != c("whole"), 1)).alias("changed"))
    items = of_item.agg(F.count("*").alias("items"))
    whole = per.join(F.broadcast(items)).withColumn("items", c("items") - c("gone")).filter("items > 0")
    return whole.select("left_out", F.round((c("items") - c("changed")) / c("items"), 6).alias("unchanged"))


ALIASES = {
    "J-CATALOG-UDF": (analytics, "D29"), "A-MULTI-CTE": (analytics, "D31"), "W-FIRST-OBSERVED": (competency, "D41"), "W-CUMULATIVE": (analytics, "M-RC-CURVE-ROWS"), "W-CUMULATIVE-TIES": (analytics, "M-RC-CURVE"), "W-TRAPEZOID": (analytics, "M-AURC"), "M-AUGRC": (analytics, "M-AURC"),
    "W-LATEST-PY": (relational, "W-LATEST"), "F-ALLEN": (analytics, "D54"), "F-FRAME-REL": (analytics, "D53"), "SRC-CHUNK-IN": (relational, "J-SEMI-IN"),
    "SRC-ATTACH": (relational, "VIEW-TIER"), "D34": (competency, "CQ14"),
}
for _key, (_module, _of) in ALIASES.items():  # Ids that the survey gives to one construct in two places
    _m = _module or __import__(__name__, fromlist=["QUERIES"])
    QUERIES[_key] = _m.QUERIES[_of]
    if _of in _m.SQL:
        SQL[_key] = _m.SQL[_of]


@add("D64")
def _(s, d):
    """Conjunctions of evidence atoms with their support and share of trusted facts."""
    a = facts(s, d).select((c("risk_tier") == "A").alias("risk_a"), c("province").isNotNull().alias("placed"), c("start_date").isNotNull().alias("dated"), (c("confidence") >= 0.8).alias("sure"), (c("source_member_count") > 1).alias("several"), (c("semantic_status") == "auto_accepted").alias("accepted"))
    rows = a.na.fill(False)
    return evaluation.frequent_rules(rows, ["dated", "placed", "risk_a", "several", "sure"], "accepted", 30, 4).withColumn("share", F.round("share", 6))


@add("D72")
def _(s, d):
    """Merged facts matched with unmerged ones of the same predicate and precision, coarsened level by level."""
    a = facts(s, d).select(c("fact_id").alias("id"), "predicate", "time_precision", "risk_tier", "merged_into")
    return evaluation.matched_controls(a.filter("merged_into is not null"), a.filter("merged_into is null"), [["predicate", "time_precision", "risk_tier"], ["predicate", "time_precision"], ["predicate"]])


@add("D74", "SELECT s.lang, count(*) AS pages, round(avg(n), 6) AS names_found FROM (SELECT lang, (SELECT count(*) FROM (VALUES ('会馆'), ('渡口'), ('祠堂'), ('码头')) v(w) WHERE contains(text, w)) AS n FROM documents WHERE text IS NOT NULL) s GROUP BY 1")
def _(s, d):
    """Recall of a word list over whole texts, by kind."""
    n = sum((c("text").contains(w).cast("int") for w in ("会馆", "渡口", "祠堂", "码头")), F.lit(0))
    return table(s, d, "documents").filter("text is not null").select("lang", n.alias("n")).groupBy("lang").agg(F.count("*").alias("pages"), F.round(F.avg("n"), 6).alias("names_found"))


@add("D57", r"SELECT doc_id, regexp_extract(text, '据本册第\d+页所载，([一-龥]+)在(\d{4})年前后曾三次易名', 1) AS place, regexp_extract(text, '据本册第\d+页所载，([一-龥]+)在(\d{4})年前后曾三次易名', 2) AS year FROM documents WHERE regexp_matches(text, '据本册第\d+页所载，([一-龥]+)在(\d{4})年前后曾三次易名')")
def _(s, d):
    """Renamed places with the year, from the text's own wording."""
    p = r"据本册第\d+页所载，([一-龥]+)在(\d{4})年前后曾三次易名"
    return table(s, d, "documents").filter(c("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 1).alias("place"), F.regexp_extract("text", p, 2).alias("year"))


@add("D56", "SELECT subject_id AS place, min(object_id) AS parent FROM assertions WHERE predicate IN ('part_of', 'located_in') AND subject_type = 'Place' AND object_type = 'Place' AND subject_id <> object_id GROUP BY 1 HAVING count(DISTINCT object_id) = 1")
def _(s, d):
    """Place relations with one parent only; hierarchy() gives their paths and cycles."""
    p = facts(s, d).filter("predicate in ('part_of', 'located_in') and subject_type = 'Place' and object_type = 'Place' and subject_id <> object_id")
    g = p.groupBy(c("subject_id").alias("place")).agg(F.min("object_id").alias("parent"), F.max("object_id").alias("other"))
    return g.filter("parent = other").select("place", "parent")


# Types that are places, ends of organisations' names, and the fields that lie in each other.
SPATIAL = ("Place", "AdministrativeRegion", "CulturalSite")
ORG_END = "(会|局|部|处|署|所|军|队|校|厂|社|馆|委|厅|司|团|党)$"
LEVELS = (("province", "city"), ("city", "county"))


def _cyclic(edges: DataFrame) -> DataFrame:
    """The distinct (child, parent) from whose parent a way leads back to the child. What leads into or out of cycles is
    trimmed off level by level; the rest is closed by doubling, so it grows with the square of the places left."""
    core, n = cut(edges.select("child", "parent").distinct()), -1
    while (left := core.count()) not in (0, n):
        n = left
        core = cut(core.join(core.select(c("parent").alias("child")).distinct(), "child", "left_semi").join(core.select(c("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"))
    reach, n = core, -1
    while (now := reach.count()) not in (0, n):
        n = now
        far = reach.select(c("child").alias("parent"), c("parent").alias("far"))
        reach = cut(reach.unionByName(reach.join(far, "parent").select("child", c("far").alias("parent"))).distinct())
    return core.join(reach.select(c("child").alias("parent"), c("parent").alias("child")), ["child", "parent"], "left_semi")


def place_relations(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(child, parent, relation, evidence_id, status): all distinct place edges, with status.

    facts: fact_id, subject_id, predicate, object_id, research_tier, and the fields of LEVELS that there are; entities:
    entity_id, name, type. Explicit strict edges are auto_typed, contextual ones needs_review; of several facts a strict
    one counts, then the smallest id. Field chains add located_in edges between names that each belong to one place and
    nothing else. Edges on cycles (self links too) are rejected; edges up to an organisation's name need review.
    """
    place = entities.filter(c("type").isin(*SPATIAL))
    end = lambda k: place.select(c("entity_id").alias(k))
    said = facts.filter("predicate in ('located_in', 'part_of') and research_tier in ('strict_semantic', 'contextual')")
    said = said.join(end("subject_id"), "subject_id", "left_semi").join(end("object_id"), "object_id", "left_semi")
    edges = said.select(c("subject_id").alias("child"), c("object_id").alias("parent"), c("predicate").alias("relation"), F.when(c("research_tier") == "strict_semantic", 0).otherwise(1).alias("rank"), "fact_id")
    names = entities.filter("name <> ''").groupBy("name").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("id"), F.min(F.coalesce(c("type").isin(*SPATIAL), F.lit(False))).alias("spatial")).filter("n = 1 and spatial")
    for high, low in LEVELS:
        if {high, low} <= set(facts.columns):
            pairs = facts.filter((c(high) != "") & (c(low) != "") & (c(high) != c(low))).groupBy(c(high).alias("high"), c(low).alias("low")).agg(F.min("fact_id").alias("fact_id"))
            at = lambda k, to: names.select(c("name").alias(k), c("id").alias(to))
            chain = pairs.join(at("high", "parent"), "high").join(at("low", "child"), "low")
            edges = edges.unionByName(chain.select("child", "parent", F.lit("located_in").alias("relation"), F.lit(2).alias("rank"), "fact_id"))
    best = edges.groupBy("child", "parent", "relation").agg(F.min(F.struct("rank", "fact_id")).alias("e"))
    best = cut(best.select("child", "parent", "relation", c("e.fact_id").alias("evidence_id"), c("e.rank").alias("rank")))
    org = place.filter(c("name").rlike(ORG_END)).select(c("entity_id").alias("parent"), F.lit(True).alias("org"))
    out = best.join(_cyclic(best).withColumn("cyclic", F.lit(True)), ["child", "parent"], "left").join(org, "parent", "left")
    status = F.when(c("cyclic"), "rejected").when((c("rank") == 1) | c("org"), "needs_review").otherwise("auto_typed")
    return out.select("child", "parent", "relation", "evidence_id", status.alias("status"))


@add("D56-EDGES")
def _(s, d):
    """The whole of D56, whose SQL states its one-parent part; the tables have no city and county, so no field chains."""
    e = base.entities(s, d).select("entity_id", c("canonical_name").alias("name"), F.coalesce("semantic_entity_type", "source_entity_type").alias("type"))
    return place_relations(facts(s, d), e)


@add("D78", "SELECT a.fact_id, start_date IS NOT NULL AS k0, province IS NOT NULL AS k1, c.fact_id IS NOT NULL AS k2, start_date IS NOT NULL AND province IS NOT NULL AND c.fact_id IS NOT NULL AS k3 FROM assertions a LEFT JOIN (SELECT DISTINCT fact_id FROM cell_support) c ON c.fact_id = a.fact_id")
def _(s, d):
    e = base.cell_support(s, d).select("fact_id", F.lit(True).alias("e")).distinct()
    a = facts(s, d).select("fact_id", "start_date", "province").join(e, "fact_id", "left")
    k0, k1, k2 = c("start_date").isNotNull(), c("province").isNotNull(), c("e").isNotNull()
    return a.select("fact_id", k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), (k0 & k1 & k2).alias("k3"))


@add("M-ISOTONIC")
def _(s, d):
    bins = evaluation.equal_count_bins(analytics.runs(s, d), 10, "score", "event_id").orderBy("bin").collect()  # ten rows
    return s.createDataFrame(evaluation.single_pass_isotonic([(float(b["score"]), float(b["correct"])) for b in bins]), "score double, accuracy double")


_FRONT = f"SELECT DISTINCT p.general_risk, p.coverage FROM ({analytics._CURVE_ALL}) p WHERE NOT EXISTS (SELECT 1 FROM ({analytics._CURVE_ALL}) q WHERE (q.general_risk < p.general_risk AND q.coverage >= p.coverage) OR (q.general_risk = p.general_risk AND q.coverage > p.coverage))"


@add("M-PARETO-KNEE", f"SELECT round(general_risk, 9) AS general_risk, round(coverage, 9) AS coverage FROM (SELECT *, round((coverage - y0) - (y1 - y0) * (CASE WHEN x1 > x0 THEN (general_risk - x0) / (x1 - x0) ELSE 0 END), 12) AS above FROM ({_FRONT}), (SELECT min(general_risk) AS x0, max(general_risk) AS x1, arg_min(coverage, general_risk) AS y0, arg_max(coverage, general_risk) AS y1 FROM ({_FRONT}))) ORDER BY above DESC, general_risk LIMIT 1")
def _(s, d):
    points = stats.risk_coverage(analytics.runs(s, d)).select("general_risk", "coverage")
    return evaluation.pareto_knee(points, "general_risk", "coverage").select(F.round("general_risk", 9).alias("general_risk"), F.round("coverage", 9).alias("coverage"))


@add("M-POSTSTRAT", f"SELECT round(sum(m * size) / sum(size), 9) AS estimate, sum(size)::BIGINT AS covered, 0::BIGINT AS empty_strata FROM (SELECT method, count(*) AS size, avg(correct) FILTER (gate) AS m FROM ({analytics._RUN}) GROUP BY 1)")
def _(s, d):
    r = analytics.runs(s, d)
    out = evaluation.poststratified(r.filter("gate"), r.groupBy("method").agg(F.count("*").alias("size")), "method", "correct")
    return out.select(F.round("estimate", 9).alias("estimate"), "covered", "empty_strata")


@add("M-FLEISS", f"SELECT round((po - pe) / (1 - pe), 9) AS kappa FROM (SELECT avg(s / nullif(m * (m - 1), 0)::DOUBLE) AS po FROM (SELECT item, sum(n) AS m, sum(n * (n - 1)) AS s FROM (SELECT item, label, count(*) AS n FROM {analytics._V} GROUP BY 1, 2) GROUP BY 1)), (SELECT sum(q * q) AS pe FROM (SELECT label, count(*) / (sum(count(*)) OVER ())::DOUBLE AS q FROM {analytics._V} GROUP BY 1))")
def _(s, d):
    v = analytics._ballots(s, d).groupBy("item", "label").agg(F.count("*").alias("n"))
    return stats.fleiss_kappa(v).select(F.round("kappa", 9).alias("kappa"))


@add("D85", f"SELECT method, round(0.5 * aurc, 9) AS rescaled FROM ({analytics.SQL['M-AURC']})")
def _(s, d):
    """Curve areas when half of the universe is eligible: coverage is scaled before the trapezoids."""
    curve = stats.risk_coverage(analytics.runs(s, d), ["method"]).withColumn("coverage", c("coverage") * 0.5)
    return stats.areas(curve, ["method"]).select("method", F.round("aurc", 9).alias("rescaled"))
