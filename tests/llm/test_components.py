from __future__ import annotations

import random

from factloom.llm.components import connected_components, record_groups


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def run(spark, links):
    return {r["vertex"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a string, b string")).collect()}


def test_random_graph(spark):
    rng = random.Random(3)
    links = [(f"v{rng.randrange(90):02d}", f"v{rng.randrange(90):02d}") for _ in range(70)]
    assert run(spark, links) == brute(links)


def test_chain_star_self_and_nulls(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    rng = random.Random(1)
    rng.shuffle(chain)
    links = chain + [("hub", f"s{i}") for i in range(50)] + [("z", "z"), ("y", None), (None, "x"), chain[0], chain[0][::-1]]
    assert run(spark, links) == brute(links)


def test_empty(spark):
    assert run(spark, []) == {}


def test_record_groups(spark):
    rows = [("f", "r2", "r1"), ("f", "r1", None), ("f", "r3", "gone"), ("f", "r4", "gone"), ("f", "r5", "away"), ("t", "r5", "r2"), ("f", None, "r1"), ("f", "r2", "r1"), ("f", "r6", "r6")]
    df = spark.createDataFrame(rows, "space string, record_id string, via string")
    assert {tuple(r) for r in record_groups(df).collect()} == {("f", "r1", "r1"), ("f", "r2", "r1"), ("f", "r3", "r3"), ("f", "r4", "r3")}
    assert record_groups(df.limit(0)).count() == 0
