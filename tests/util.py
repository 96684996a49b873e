"""Comparison of a Spark result with an oracle's rows."""

from __future__ import annotations

import math
from decimal import Decimal


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    names = sorted(columns)
    at = [list(columns).index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def assert_same(df, con, sql):
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [x[0] for x in cursor.description]
    assert mine == rows_of(columns, cursor.fetchall())
