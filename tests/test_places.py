"""Place edges: several parents, field chains by unique name, cycles and organisations' names."""

from __future__ import annotations

from factloom.plans import curation


def test_place_relations(spark):
    names = {x: x for x in "abcdefghi"} | {"o": "某某队", "p": "东省", "q": "西市", "r": "北县", "s": "同名", "t": "同名", "u": "南市", "v": "南市"}
    types = {"i": "Person", "v": "Person"}
    entities = spark.createDataFrame([(k, n, types.get(k, "Place")) for k, n in names.items()], "entity_id string, name string, type string")
    links = ["ab", "ac", "ab", "bd", "de", "ed", "fd", "gg", "eh", "ai", "ao"]
    rows = [(f"F{i:02}", x[0], "part_of", x[1], "contextual" if i == 1 else "strict_semantic", None, None, None) for i, x in enumerate(links)]
    rows += [("F50", "b", "part_of", "h", "unresolved", None, None, None), ("F60", "x", "led", "y", "strict_semantic", "东省", "西市", "北县"), ("F61", "x", "led", "y", "strict_semantic", "东省", "同名", None), ("F62", "x", "led", "y", "strict_semantic", "东省", "南市", "")]
    facts = spark.createDataFrame(rows, "fact_id string, subject_id string, predicate string, object_id string, research_tier string, province string, city string, county string")
    out = curation.place_relations(facts, entities).collect()
    got = {r["child"] + r["parent"]: r["status"] for r in out}
    assert len(out) == len(got) and got == {
        "ab": "auto_typed", "ac": "needs_review", "bd": "auto_typed", "de": "rejected", "ed": "rejected", "fd": "auto_typed", "gg": "rejected", "eh": "auto_typed", "ao": "needs_review", "qp": "auto_typed", "rq": "auto_typed",
    }
    assert curation.place_relations(facts.limit(0), entities).count() == 0
