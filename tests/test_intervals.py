from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators.intervals import merge_intervals, partial_date

S = "k string, s date, e date, start string"


def brute(rows):
    days, out = {}, set()
    for k, s, e in rows:
        if k is not None and s and e and s <= e:
            days.setdefault(k, set()).update(s + timedelta(i) for i in range((e - s).days + 1))
    for k, d in days.items():
        d, start = sorted(d), None
        for a, b in zip([None, *d], [*d, None], strict=True):
            if a and b and b - a > timedelta(1):
                out.add((k, "gap", a + timedelta(1), b - timedelta(1)))
            if a is None or b is None or b - a > timedelta(1):
                if start is not None:
                    out.add((k, "period", start, a))
                start = b
    return out


@pytest.mark.parametrize("shard", [7, 64, 4096])
def test_against_brute_force(spark, shard):
    rng, rows = random.Random(shard), []
    for _ in range(300):
        s = date(1930, 1, 1) + timedelta(rng.randrange(1500))
        rows.append((rng.choice("abcc"), s, s + timedelta(rng.choice([0, 1, 3, 20, -2])), "x"))
    rows += [rows[0], ("a", None, date(1930, 1, 1), "x"), (None, date(1930, 1, 1), date(1930, 1, 2), "x")]
    out = merge_intervals(spark.createDataFrame(rows, S), "k", "s", "e", shard)
    assert {tuple(r) for r in out.collect()} == brute([r[:3] for r in rows])
    assert out.count() == len(brute([r[:3] for r in rows]))


def test_empty(spark):
    assert merge_intervals(spark.createDataFrame([], S), "k", "s", "e").count() == 0


def test_partial_dates(spark):
    cases = {
        "1941-01-05": "1941-01-05", "１９５９-０２-０７": "1959-02-07", "1923.1.9": "1923-01-09", "1933/12/03": "1933-12-03", "1954年10月24日": "1954-10-24",
        "1932-10-25 00:00:00": "1932-10-25", " 1940-03-24": "1940-03-24", "1939-02": ("1939-02-01", "1939-02-28"), "1927": ("1927-01-01", "1927-12-31"), "1927年": ("1927-01-01", "1927-12-31"),
        "1927年3月": ("1927-03-01", "1927-03-31"), "1941-02-30": None, "1941-13": None, "1941-00-10": None, "约三十年代": None, "?": None, "": None, "0000-01-01": None, "1941-01-05 noon": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", partial_date(F.col("t"), False).alias("a"), partial_date(F.col("t"), True).alias("b"))
    for r in df.collect():
        want = cases[r["t"]]
        a, b = want if isinstance(want, tuple) else (want, want)
        assert (str(r["a"]) if r["a"] else None, str(r["b"]) if r["b"] else None) == (a, b), r
