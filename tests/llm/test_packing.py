from __future__ import annotations

import random

import numpy as np

from factloom.llm import packing


def test_sum_of_squares_holds_capacity():
    rng = random.Random(1)
    sizes = np.array([rng.randint(0, 100) for _ in range(2000)])  # half of them over half the capacity: a hard case
    sizes = sizes[packing.placing_order(range(2000), sizes, 100)]
    box = packing.sum_of_squares(sizes, 100)
    load = np.bincount(box, weights=sizes)
    assert load.max() <= 100 and load.sum() == sizes.sum() and len(load) <= np.ceil(sizes.sum() / 100) * 1.03
    assert packing.sum_of_squares(np.zeros(0, int), 10).tolist() == [] and packing.sum_of_squares(np.array([0, 0, 0]), 10).tolist() == [0, 0, 0]


def test_against_direct_rule():
    rng = random.Random(2)
    sizes, cap = [rng.randint(1, 12) for _ in range(150)], 12
    gaps, want = [], []
    for s in sizes:
        def cost(g):
            after = [x for x in gaps]
            if g is not None:
                after.remove(g)
            after.append((cap if g is None else g) - s)
            return sum(after.count(h) ** 2 for h in set(after) if h > 0)
        best = min([*sorted({g for g in gaps if g >= s}), None], key=lambda g: (cost(g), g is None, g or 0))
        if best is not None:
            gaps.remove(best)
        gaps.append((cap if best is None else best) - s)
        want.append(best is None)
    box = packing.sum_of_squares(np.array(sizes), cap)
    opened = [b not in set(box[:i].tolist()) for i, b in enumerate(box.tolist())]
    assert opened == want


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 5, 17, 40, 63, 100, 101, 250, 300]), 1) for i in range(700)] + [(900, None, 1), (None, 5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, item int")
    prof = spark.createDataFrame([(1, 100), (2, 1000), (2, 1000), (3, None), (4, 0)], "profile_id int, capacity_tokens long")
    out = packing.pack(df, prof, "doc_id").collect()
    again = packing.pack(df.repartition(7), prof, "doc_id").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    for p, cap in ((1, 100), (2, 1000)):
        mine = [r for r in out if r["profile_id"] == p]
        load, parts = {}, {}
        for r in mine:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
            parts.setdefault(r["doc_id"], []).append((r["part_no"], r["start_token"], r["n_tokens"]))
        assert max(load.values()) <= cap and set(parts) == {i for i, *_ in rows if i is not None}
        for i, n, _ in rows:
            if i is not None:
                pieces = sorted(parts[i])
                assert sum(x[2] for x in pieces) == (n or 0) and (len(pieces) == 1 or (n or 0) > cap)
                assert [x[1] for x in pieces] == [sum(y[2] for y in pieces[:k]) for k in range(len(pieces))]
        assert len(load) <= 1.1 * np.ceil(sum(load.values()) / cap) + 2
    assert {r["profile_id"] for r in out} == {1, 2}
    assert packing.pack(df.limit(0), prof, "doc_id").count() == 0 and packing.pack(df, prof.limit(0), "doc_id").count() == 0
    report = packing.fill_report(packing.pack(df, prof, "doc_id"), prof.dropna().distinct()).collect()
    assert all(r["fullest"] <= r["capacity_tokens"] and r["used_share"] > 0.85 for r in report)


def test_sizes_of_which_no_two_fit_go_no_further(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 200)
    seen = []
    real = packing._pack_group

    def watched(level, capacities):
        seen.append(level)
        return real(level, capacities)

    monkeypatch.setattr(packing, "_pack_group", watched)
    rng = random.Random(4)
    prof = spark.createDataFrame([(1, 100)], "profile_id int, capacity_tokens long")
    sizes = [rng.randint(51, 98) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    assert packing.pack(df, prof, "doc_id").select("container_id").distinct().count() == 3000 and seen == [0]
    filled = spark.createDataFrame([(1, f"c{i}", n) for i, n in enumerate([*sizes, *[20] * 50, 49, 50])], "profile_id int, container_id string, n_tokens long")
    kept, n = packing._going_on(filled, {1: 100}, 0.995)
    loads = sorted(r["n_tokens"] for r in kept.collect())
    assert n == 104 and loads[:52] == [20] * 50 + [49, 50] and len(loads) < 52 + 52 * 1.6 and max(loads) <= 53


def test_small_blocks_fill_the_full_ones_of_other_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 300)
    rng = random.Random(6)
    sizes = [70 if i % 10 else 30 for i in range(3000)] + [rng.randint(1, 30) for _ in range(2000)]
    prof = spark.createDataFrame([(1, 100)], "profile_id int, capacity_tokens long")
    out = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long"), prof, "doc_id")
    load = {r["container_id"]: r["t"] for r in out.groupBy("container_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    assert max(load.values()) <= 100 and sum(load.values()) == sum(sizes) and len(load) == 2700
