from __future__ import annotations

import random

from factloom.operators.hierarchy import code_key, descendant_pairs, hierarchy, other_parents
from pyspark.sql import functions as F

S = "child string, parent string, path string"


def brute(links):
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up[c] = min(up.get(c, p), p)
    out = {}
    for n in set(up) | set(up.values()):
        trail, x = [n], n
        while x in up and up[x] not in trail:
            x = up[x]
            trail.append(x)
        if x not in up:
            out[n] = (x, len(trail) - 1, ">".join(reversed(trail)), "none")
        else:
            at = trail.index(up[x])
            ring = trail[at:]
            out[n] = (min(ring), at, ">".join(reversed(trail[: at + 1])), "on" if at == 0 else "below")
    return out


def got(df):
    return {r["node"]: (r["root"], r["depth"], r["path"], r["cycle_state"]) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(7)
    links = [(f"n{i:02d}", f"n{rng.randrange(60):02d}", "x") for i in range(60) if rng.random() < 0.9]
    links += [("n01", None, "x"), (None, "n02", "x"), links[0], links[1]]
    assert got(hierarchy(spark.createDataFrame(links, S), "child", "parent")) == brute([x[:2] for x in links])


def test_self_link_two_ring_and_tail(spark):
    links = [("a", "a", ""), ("b", "c", ""), ("c", "b", ""), ("d", "c", ""), ("e", "d", "")]
    out = got(hierarchy(spark.createDataFrame(links, S), "child", "parent"))
    assert out["a"] == ("a", 0, "a", "on") and out["b"] == ("b", 0, "b", "on") and out["e"] == ("b", 2, "c>d>e", "below")


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], S), "child", "parent").count() == 0


def test_several_parents_and_descendants(spark):
    df = spark.createDataFrame([("c", "b", ""), ("c", "a", ""), ("b", "a", "")], S)
    nodes = hierarchy(df, "child", "parent")
    assert got(nodes)["c"] == ("a", 1, "a>c", "none")
    assert [tuple(r) for r in other_parents(df, "child", "parent").collect()] == [("c", "b")]
    pairs = {tuple(r) for r in descendant_pairs(nodes).select("ancestor", "descendant", "distance").collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 1)}


def test_code_key(spark):
    df = spark.createDataFrame([(" Part-Of",), ("partOf",), ("ｐａｒｔ＿ｏｆ",), ("part__of",), (None,)], "c string")
    assert [r[0] for r in df.select(code_key(F.col("c"))).collect()] == ["partof"] * 4 + [None]


def test_long_chain_reads_the_links_about_twice(spark, monkeypatch):
    from factloom.operators import hierarchy as module

    laid_out = []
    real = module.cut

    def watched(df):
        out = real(df)
        if out.columns[:2] == ["parent", "node"] or out.columns == ["node", "parent"]:
            laid_out.append(out.count())
        return out

    monkeypatch.setattr(module, "cut", watched)
    links = [(f"n{i + 1:03d}", f"n{i:03d}", "") for i in range(120)] + [(f"m{i:03d}", "n000", "") for i in range(200)]
    nodes = hierarchy(spark.createDataFrame(links, S), "child", "parent")
    rows = {r["node"]: r for r in nodes.collect()}
    assert rows["n120"]["depth"] == 120 and rows["n120"]["ids"] == [f"n{i:03d}" for i in range(121)] and len(rows) == 321
    assert sum(laid_out) <= 3 * len(links)


def test_ids_with_the_separator(spark):
    nodes = hierarchy(spark.createDataFrame([("b>x", "a>", ""), ("c", "b>x", "")], S), "child", "parent")
    assert {tuple(r) for r in descendant_pairs(nodes).collect()} == {("a>", "b>x", 1), ("a>", "c", 2), ("b>x", "c", 1)}


def test_deep_ways_and_rings_take_few_jobs(spark, monkeypatch):
    from factloom.operators import hierarchy as module

    cuts, cut, kept = [], module.cut, module.kept
    monkeypatch.setattr(module, "cut", lambda df: cuts.append(1) or cut(df))
    monkeypatch.setattr(module, "kept", lambda *dfs: cuts.append(1) or kept(*dfs))
    links = [(f"n{i + 1:03d}", f"n{i:03d}") for i in range(200)] + [("x", "n150"), ("s", "s"), ("t", "s")]
    links += [(f"r{i:02d}", f"r{(i + 1) % 40:02d}") for i in range(40)] + [("q00", "r07")] + [(f"q{i + 1:02d}", f"q{i:02d}") for i in range(25)]
    nodes = hierarchy(spark.createDataFrame([(c, p, "") for c, p in links], S), "child", "parent")
    assert got(nodes) == brute(links) and len(cuts) <= 30  # 60 and more where each four levels are a job
