"""Scalar functions on text, dates and numbers as column expressions (section 2.8 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: str | Column) -> Column:
    """F-HASH-ID: prefix and the first 24 hex digits of the SHA-256 of the parts joined by U+001F; null parts drop out."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))


def stable_id_nulls(prefix: str, *parts: Column) -> Column:
    """F-HASH-ID-VARIANTS: null parts count as empty text, so their place stays."""
    return stable_id(prefix, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def stable_id_spaces(prefix: str, *parts: Column) -> Column:
    """F-HASH-ID-VARIANTS: runs of white space in a part count as one blank, ends are trimmed."""
    return stable_id(prefix, *(F.trim(F.regexp_replace(F.coalesce(p, F.lit("")), r"\s+", " ")) for p in parts))


def hash_uniform(*parts: str | Column) -> Column:
    """F-HASH-UNIFORM: a number in [0, 1) from the first 12 hex digits of the SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12), 16, 10).cast("double") / float(16**12)


def hash_split(k: int, *parts: str | Column) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12), 16, 10).cast("long"), F.lit(k))


def ab_order(seed: str, task: Column) -> Column:
    """D82: 'AB' or 'BA' by the parity of the first byte of the SHA-256 of seed::task."""
    byte = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "::"), task), 256), 1, 2), 16, 10).cast("int")
    return F.when(byte % 2 == 0, "AB").otherwise("BA")


def bounded_levenshtein(a: Column, b: Column, limit: int = 3) -> Column:
    """F-LEVENSHTEIN: the edit distance, limit + 1 where it is greater."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def tight(text: Column) -> Column:
    """F-STR-NORM, the part that SQL has too: lower case, without white space and middle dots."""
    return F.lower(F.regexp_replace(text, r"[\s·・‧]+", ""))


def strip_suffix(name: Column, suffixes: list[str]) -> Column:
    """F-STR-SUFFIX: the first of the suffixes that the name ends with is cut off, only if something remains."""
    out = name
    for s in reversed(suffixes):
        out = F.when(name.endswith(s) & (F.length(name) > len(s)), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    return out


def allen(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """F-ALLEN: nine-way relation of two intervals, the first true case: only an end on the other's start meets, and shared
    days at one end count inside."""
    return (
        F.when(e1 < s2, "before").when(s1 > e2, "after").when(e1 == s2, "meets").when((s1 == s2) & (e1 == e2), "equals")
        .when((s1 == s2) & (e1 < e2), "starts").when((e1 == e2) & (s1 > s2), "ends").when((s1 >= s2) & (e1 <= e2), "during")
        .when((s1 <= s2) & (e1 >= e2), "contains").otherwise("overlaps")
    )


def coarser(p: Column, q: Column) -> Column:
    """The coarser of two precisions: unknown, period, year, month from coarse to fine."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, ("unknown", "period", "year", "month"))), c)
    return F.when(rank(p) <= rank(q), p).otherwise(q)


def bin_of(value: Column, edges: list[float], labels: list[str]) -> Column:
    """F-BIN: labels[i] for values up to edges[i], the last label beyond; null stays null."""
    out = F.lit(labels[-1])
    for e, x in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(value <= e, x).otherwise(out)
    return F.when(value.isNotNull(), out)


def entropy(p: Column) -> Column:
    """F-MATH: binary entropy in bits, 0 at the ends."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))
