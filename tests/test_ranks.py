from __future__ import annotations

import random

from pyspark.sql import functions as F

from factloom.operators.ranks import running


def test_places_and_sums_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(50), i, rng.choice([1, 2, None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x int, id int, v int")
    got = {r["id"]: (r["__place"], r["s"], r["__n"]) for r in running(df, ["g"], [F.col("x").desc(), F.col("id")], {"s": F.col("v")}, totals=True).collect()}
    for g in ("hot", "a", None):
        total = 0
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        for place, r in enumerate(mine, 1):
            total += r[3] or 0
            assert got[r[2]] == (place, total, len(mine))
    assert [r["__place"] for r in running(df, [], [F.col("id")]).orderBy("id").collect()] == list(range(1, 2001))
    assert running(df.limit(0), ["g"], [F.col("id")]).count() == 0
