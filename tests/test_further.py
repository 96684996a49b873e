"""Operators of the core against brute force, published cases and plain rules."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation
from factloom.operators.graph import components, shortest_path
from factloom.operators.pairs import pairs_within
from factloom.plans import curation, further
from factloom.plans.analytics import allowed


def test_pairs_within(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else rng.choice("abc"), rng.randrange(5)) for i in range(90)] + [(200, None, 1)]
    df = spark.createDataFrame(rows, "id int, k string, v int")
    got = {(r["a_id"], r["b_id"]) for r in pairs_within(df, ["k"], (F.col("a_id") < F.col("b_id")) & (F.col("a_v") == F.col("b_v")), pair_rows=7).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and a[0] < b[0] and a[2] == b[2]}
    assert pairs_within(df.limit(0), ["k"], F.lit(True)).count() == 0


def test_pairs_of_a_hot_key_send_a_row_seldom(spark):
    from factloom.operators import pairs

    df = spark.range(400).select("id", F.lit("hot").alias("k"))
    left, right = pairs.dealt(df, ["k"], 4, "id")
    assert left.count() == right.count() == 400 * 10  # 100 cells; one line of cells would send each right row 100 times
    assert left.join(right, ["k", "__cell"]).select("a_id", "b_id").distinct().count() == left.join(right, ["k", "__cell"]).count() == 400**2


def test_components_against_search(spark):
    rng = random.Random(3)
    links = [(f"v{rng.randrange(60):02d}", f"v{rng.randrange(60):02d}") for _ in range(45)] + [("z", "z"), ("y", None)]
    links += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + links[:3]
    near = {}
    for a, b in links:
        if b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            todo += [w for w in near[todo.pop()] if w not in seen and not seen.add(w)]
        want[v] = min(seen)
    df = spark.createDataFrame(links, "a string, b string")
    assert {r["vertex"]: r["component"] for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_paths_have_no_limit(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(16)], "src string, dst string")
    assert [r["id"] for r in shortest_path(edges, "n00", "n16").orderBy("hop").collect()] == [f"n{i:02d}" for i in range(17)]
    assert shortest_path(edges, "n00", "n16", max_hops=3).count() == 0 and shortest_path(edges, "n00", "none").count() == 0


def test_as_of(spark):
    rng = random.Random(4)
    left = [(i, rng.choice(["u", "u", "v", None]), rng.choice([*range(20), None])) for i in range(120)]
    right = [(rng.choice(["u", "v", None]), rng.choice([*range(20), None]), rng.choice([None, *range(9)])) for _ in range(40)]
    got = further.as_of(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, x int"), "k", "t", "x")
    for r in got.collect():
        older = [(t, x) for k, t, x in right if k is not None and k == r["k"] and None not in (t, x, r["t"]) and t <= r["t"]]
        assert r["x"] == (max(older)[1] if older else None)
    assert got.count() == len(left)


S = "method string, score double, correct int, gate boolean"


def _rows(n=400, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        score = round(rng.random(), 2)
        out.append(("m", score, int(rng.random() < score), rng.random() < 0.9))
    return out


def _best(rows, accepted, grid):
    best, most = None, None
    for t in grid:
        some = [r for r in rows if accepted(r, t)]
        cov = len(some) / len(rows)
        u = round((sum(r[2] and r[3] for r in some) - sum(not r[2] for r in some) - 0.5 * sum(not r[3] for r in some)) / len(rows), 12)
        if cov >= 0.3 and (best is None or u > best[0]):
            best = (u, t)
        if most is None or cov > most[0]:
            most = (cov, t)
    return (best or most)[1]


def test_thresholds(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, S)
    assert further.learn_threshold(df, ["method"]).first()["threshold"] == pytest.approx(_best(rows, lambda r, t: r[1] >= t, [i / 20 for i in range(1, 21)]))
    low = [("m", 0.01, 1, True)] * 10
    assert further.learn_threshold(spark.createDataFrame(low, S), ["method"]).first()["threshold"] == 0.05  # none accepts enough
    risks = [(m, round(1 - x, 2), k, g) for m, x, k, g in rows]
    tau = further.learn_tau(spark.createDataFrame(risks, "method string, risk double, correct int, gate boolean"), ["method"]).first()["tau"]
    assert tau == pytest.approx(_best(risks, lambda r, t: r[1] <= t + 1e-9, sorted({0.0, *(r[1] for r in risks)})))
    assert further.learn_threshold(df.limit(0), ["method"]).count() == further.learn_tau(df.limit(0).withColumn("risk", F.col("score")), ["method"]).count() == 0


def test_class_gate(spark):
    s = "kind string, score double, correct int"
    good = [("a", 0.9, 1)] * 400 + [("a", 0.3, 0)] * 50 + [("b", 0.9, 1)] * 49 + [("c", 0.9, 1)] * 60 + [("d", 0.8, 1)] * 95 + [("d", 0.8, 0)] * 5
    got = {r["kind"]: r["threshold"] for r in curation.class_gate(spark.createDataFrame(good, s), ["kind"]).collect()}
    assert got == {"a": 0.35}  # b has too few rows, c too wide an interval, d too many errors


def test_provenance(spark):
    facts = spark.createDataFrame([("f1", "张三", "x"), ("f2", "李四", "王五"), ("f3", "a", None), ("f4", "甲乙", None)], "fact_id string, subject_name string, object_name string")
    texts = [("f1", "1", "见张三。"), ("f2", "1", "无"), ("f2", "2", "无"), ("f2", "3", "无"), ("f2", "4", "李四"), ("f3", "1", "a a"), ("f4", "1", ""), (None, "1", "甲乙")]
    got = {r["fact_id"]: r["alignment"] for r in curation.provenance_alignment(facts, spark.createDataFrame(texts, "fact_id string, rank string, text string")).collect()}
    assert got == {"f1": "aligned", "f2": "mismatch_with_evidence", "f3": "mismatch_with_evidence", "f4": "no_evidence"}


def test_bootstrap_is_near_the_normal_interval(spark):
    df = spark.createDataFrame([("s", 1, 300), ("s", 0, 700), ("t", 1, 900), ("t", 0, 100), ("t", None, 5)], "st string, v int, n int")
    low, high = evaluation.bootstrap(df.groupBy("v").agg(F.sum("n").alias("n")), evaluation.mean_of, "v")
    assert abs((low + high) / 2 - 0.6) < 0.005 and abs((high - low) / 2 - 1.96 * np.sqrt(0.24 / 2000)) < 0.002
    a, b = evaluation.bootstrap(df, evaluation.mean_of, "v", "st")
    assert abs((b - a) / 2 - 1.96 * np.sqrt((0.21 * 1000 + 0.09 * 1000) / 2000**2)) < 0.002 and b - a < high - low
    assert evaluation.bootstrap(df.limit(0), evaluation.mean_of, "v") is None


def test_pareto_knee_as_on_the_driver(spark):
    rng = random.Random(6)
    points = [(round(rng.random(), 2), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame([*points, (None, 0.5)], "c double, g double")
    assert tuple(evaluation.pareto_knee(df, "c", "g").first()) == evaluation.knee(points)
    assert evaluation.pareto_knee(df.limit(0), "c", "g").count() == 0


def test_type_hierarchy():
    assert {"AdministrativeRegion", "CulturalSite", "Place"} <= set(allowed("Place")) and {"Institution", "SocialGroup"} <= set(allowed("Organization"))
    assert "Institution" not in allowed("Place") and "Spirit" not in allowed("Event") and allowed("Person") == ["Person"]


def test_longest_names(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "在甲省乙乙省"), (2, "无"), (3, None), (4, ""), (5, "x" * 50_000 + "甲省")], "doc_id long, text string")
    names = spark.createDataFrame([("甲省",), ("乙乙省",), ("",), (None,), ("甲省",)], "name string")
    want = {1: 3, 5: 2}
    assert {r["doc_id"]: r["longest"] for r in curation.longest_names(docs, names).collect()} == want
    monkeypatch.setattr(curation, "DICTIONARY", 1)
    assert {r["doc_id"]: r["longest"] for r in curation.longest_names(docs, names).collect()} == want
    assert curation.longest_names(docs, names.limit(0)).count() == 0


def test_publication_gate(spark):
    from factloom.plans.base import publication_gate

    good, s = "trusted_event_spacetime", "fact_id string, rule_kind string, from_region_id string, from_stage_order int, from_observation_tier string, to_observation_tier string, k string"
    rows = [("f", "direct", "R1", 1, good, good, "A"), ("f", "direct", "R2", 1, good, good, "B"), ("g", "direct", "R1", 1, good, good, "A"), ("g", "direct", "R2", 1, good, good, "B"), ("h", "direct", "R1", 1, good, good, "A")]
    rows += [("h", "spatial", "R1", 1, good, good, "S"), ("i", "direct", "R1", 1, good, "relation_context", "N"), ("i", "direct", "R1", 1, good, None, "M")]
    regions = spark.createDataFrame([("f", "R2"), ("f", "R2")], "fact_id string, region_id string")
    stages = spark.createDataFrame([("f", 1), ("g", 1)], "fact_id string, stage_order int")
    got = {(r["fact_id"], r["k"]): r["publication_gate_reason"] for r in publication_gate(spark.createDataFrame(rows, s), regions, stages).collect()}
    many = "ambiguous_spatiotemporal_expansion"
    assert got == {
        ("f", "A"): many, ("f", "B"): "unique_explicit_spatiotemporal_match", ("g", "A"): many, ("g", "B"): many, ("h", "A"): "unique_trusted_state_pair",
        ("h", "S"): "spatial_review_required", ("i", "N"): "nontrusted_state", ("i", "M"): "nontrusted_state",
    }
