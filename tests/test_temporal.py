"""Allen pairs of the three candidate families, on the reference's fixture rows and against brute force."""

from __future__ import annotations

import datetime as dt
import random

from factloom.plans import analytics

FACT = "fact_id string, subject_id string, start_date date, end_date date, time_precision string, merged_into string"
LINK = "event_id string, fact_id string"
SUPPORT = "culture_subject_id string, state_id string, fact_id string"


def day(text):
    return dt.date.fromisoformat(text) if text else None


def run(spark, facts, links=(), support=()):
    f = [(i, s, day(a), day(b), p, m) for i, s, a, b, p, m in facts]
    out = analytics.temporal_pairs(spark.createDataFrame(f, FACT), spark.createDataFrame(list(links), LINK), spark.createDataFrame(list(support), SUPPORT)).collect()
    got = {(r["a"], r["b"]): (r["relation"], r["precision"], r["family"]) for r in out}
    assert len(got) == len(out)
    return got


def test_reference_codes(spark):
    spans = ["09-01 09-30", "01-01 01-31", "02-01 03-01", "03-01 04-15", "03-15 06-30", "04-01 04-30", "03-15 06-30", "03-15 12-31", "01-01 06-30", "04-05 04-25", "04-01 04-30"]
    precise = {0: "period", 1: "month", 2: "year"}
    facts = [(f"F{i:02}", "S1", *(f"1938-{x}" for x in s.split()), precise.get(i, "month"), None) for i, s in enumerate(spans)]
    got = run(spark, facts)
    want = {(0, 1): "after", (1, 2): "before", (2, 3): "meets", (3, 4): "overlaps", (4, 5): "contains", (4, 6): "equals", (4, 7): "starts", (4, 8): "ends", (9, 10): "during"}
    assert {k: got[f"F{k[0]:02}", f"F{k[1]:02}"][0] for k in want} == want and len(got) == 55
    assert got["F00", "F01"][1] == "period" and got["F01", "F02"][1] == "year"


def test_families(spark):
    y = ("1938-01-01", "1938-12-31")
    facts = [("A", "S1", *y, "year", None), ("B", "S1", *y, None, None), ("C", "S2", *y, "month", None), ("D", "S3", *y, "day", None), ("E", None, *y, None, None), ("M", "S1", *y, "year", "A"), ("U", "S1", None, "1938-12-31", "year", None)]
    links = [("E1", "A"), ("E1", "A"), ("E1", "B"), ("E1", "C"), ("E1", "M"), (None, "D"), (None, "A")]
    support = [("K", "T1", "A"), ("K", "T2", "C"), ("K", "T2", "D"), ("K", "T1", "E"), (None, "T3", "B"), (None, "T4", "D")]
    got = {k: v[2] for k, v in run(spark, facts, links, support).items()}
    assert got == {("A", "B"): "same_subject", ("A", "C"): "same_event", ("B", "C"): "same_event", ("A", "D"): "same_state_subject", ("C", "E"): "same_state_subject", ("D", "E"): "same_state_subject"}
    assert run(spark, []) == {}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(analytics, "PAIR_ROWS", 3)
    rng = random.Random(4)
    pick = lambda k, n: f"{k}{rng.randrange(n)}"
    facts = [(f"F{i:02}", pick("S", 4), f"190{rng.randrange(3)}-01-01", f"190{rng.randrange(3)}-01-01", "year", None) for i in range(40)]
    links, support = [(pick("E", 9), f[0]) for f in facts], [(pick("K", 3), pick("T", 5), f"F{rng.randrange(40):02}") for _ in range(60)]
    subject, of = {f[0]: f[1] for f in facts}, lambda f: [x for x in support if x[2] == f]
    want = {}
    for a in subject:
        for b in (x for x in subject if a < x):
            if subject[a] == subject[b]:
                want[a, b] = "same_subject"
            elif any((e, b) in links for e, f in links if f == a):
                want[a, b] = "same_event"
            elif any(x[0] == z[0] and x[1] != z[1] for x in of(a) for z in of(b)):
                want[a, b] = "same_state_subject"
    assert {k: v[2] for k, v in run(spark, facts, links, support).items()} == want
