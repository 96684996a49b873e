from __future__ import annotations

import random

from factloom.llm.consensus import clean_votes, consensus, item_agreement, named_by_most, spectral_reliability

LABELS = ["A_X", "B_X", "C_X"]
S = "task string, rater string, label string, at int, item string"


def votes(n=400, seed=4):
    rng, rows, truth = random.Random(seed), [], {}
    skill = {"r1": 0.95, "r2": 0.8, "r3": 0.75, "r4": 0.7, "r5": 0.33, "spam": None, "swap": "swap"}
    for i in range(n):
        t = truth[f"t{i}"] = rng.choice(LABELS)
        for r in rng.sample(sorted(skill), 5):
            p = skill[r]
            if p is None:
                label = "C_X"
            elif p == "swap":
                label = {"A_X": "B_X", "B_X": "A_X", "C_X": "C_X"}[t]
            else:
                label = t if rng.random() < p else rng.choice(LABELS)
            rows.append((f"t{i}", r, rng.choice([label, label.lower(), f" {label.replace('_', '-')}", label.replace("_", " ") + "\xa0"]), 1, ""))
    return rows, truth


def test_reliability_and_consensus(spark):
    rows, truth = votes()
    rows += [rows[0], ("t0", "r9", None, 1, ""), ("t0", "r9", "SKIP", 1, ""), (None, "r1", "A_X", 1, ""), ("t1", None, "A_X", 1, "")]
    clean = clean_votes(spark.createDataFrame(rows, S), "task", "rater", "label", LABELS, "at").cache()
    assert clean.count() == len({x[:2] for x in rows[:2000]})
    rel = {r["rater"]: r["reliability"] for r in spectral_reliability(clean, LABELS).collect()}
    assert rel["r1"] > rel["r2"] > 0.5 and abs(rel["spam"]) < 0.1
    assert all(abs(rel[r] - p) < 0.15 for r, p in (("r1", 0.95), ("r2", 0.8), ("r3", 0.75), ("r4", 0.7), ("r5", 0.33)))  # right with p, else by chance
    best, _ = consensus(clean, LABELS, sharpen=2)
    got = {r["item"]: r["consensus"] for r in best.collect()}
    good = sum(got[t] == x for t, x in truth.items()) / len(truth)
    count = {}
    for t, r, label in {(x["item"], x["rater"], x["label"]) for x in clean.collect()}:
        count.setdefault(t, []).append(label)
    plain = sum(max(sorted(set(v)), key=v.count) == truth[t] for t, v in count.items()) / len(truth)
    assert good > 0.95 and good > plain
    alone = {r["item"]: r["consensus"] for r in consensus(clean, LABELS)[0].collect()}
    assert sum(alone[t] == x for t, x in truth.items()) / len(truth) > plain  # the spectral weights alone
    share = {r["item"]: r for r in item_agreement(clean, best).collect()}
    assert len(share) == len(got) and all(0 <= r["consensus_share"] <= 1 for r in share.values())


def test_latest_vote_counts_and_empty(spark):
    df = spark.createDataFrame([("t", "r", "a_x", 1, ""), ("t", "r", "B X", 2, "")], S)
    assert [r["label"] for r in clean_votes(df, "task", "rater", "label", LABELS, "at").collect()] == ["B_X"]
    best, rel = consensus(clean_votes(df.limit(0), "task", "rater", "label", LABELS), LABELS)
    assert best.count() == 0 and rel.count() == 0


def test_named_by_most(spark):
    passes = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 2), (2, 0), (2, 1)], "page long, vote int")
    naming = spark.createDataFrame([(1, 0, "e"), (1, 0, "e"), (1, 1, "e"), (1, 2, "f"), (2, 0, "g")], "page long, vote int, label string")
    assert {tuple(r) for r in named_by_most(passes, naming, "page", "vote", "label").select("page", "label", "n_naming").collect()} == {(1, "e", 2)}


def test_items_without_votes(spark):
    votes = spark.createDataFrame([("t", "r", "A_X"), ("t", "s", "A_X")], "item string, rater string, label string")
    best = spark.createDataFrame([("t", "A_X"), ("u", "B_X")], "item string, consensus string")
    got = {r["item"]: (r["n_votes"], r["consensus_share"], r["pair_agreement"]) for r in item_agreement(votes, best).collect()}
    assert got == {"t": (2, 1.0, 1.0), "u": (0, None, None)}
