"""Visually identical text with different characters to one consistent form (problem 1).

A transducer over grapheme clusters, compiled once. Rules for widths, kinds of space, invisible characters, compatibility
forms and look-alike letters and signs are closed under themselves and checked for conflicts. From them the mapping of
whole clusters (a base with its marks in every order and composition, Hangul from its parts) is computed ahead; the pass
over a text takes the longest cluster at each place and rewrites it by that mapping. Stacks of marks beyond the mapping go
through the same tables sign by sign.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.session import cut

# Letters and signs that readers can't tell apart, each pair as look-alike and its plain form, by script.
LOOK_ALIKE_LETTERS = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ӀI ԌG ԚQ ԜW ѴV ѵv ҮY "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϹC ϲc ͿJ ϳj "
    "ՍU ՕO օo հh ցg ոn յj զq "
    "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB "
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    "ɑa ɡg"
)
LOOK_ALIKE_SIGNS = "··‧·・·•·∙·⋅·᛫·ㆍ· ’'‘'ʼ'ʹ'′'＇' ‐-‑-−-﹣- ∕/⁄/ ∶: ∗* ˗- ﹒. ﹐, ﹕: ﹔; “\"”\"‟\"″\""
VISIBLE_FORMAT = range(0x0600, 0x0606)
OTHER_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"
OTHER_SPACES = "\t"
# What counts as the same to the eye of the compatibility forms: kinds, and blocks of the kind 'compat'.
SAME_KINDS = ("wide", "narrow", "font", "noBreak", "initial", "medial", "final", "isolated")
SAME_BLOCKS = "132-133 13f-140 149 1c4-1cc 1f1-1f3 2024-2026 203c 2047-2049 2160-217f 2e80-2fdf fb00-fb06 fb13-fb17"

# The ranges of the standard in which characters change, and of Hangul.
CHANGING_RANGES = (range(0x80, 0xD800), range(0xE000, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200))
JAMO = r"\u1100-\u115e\u1161-\u11ff\ua960-\ua97c\ud7b0-\ud7fb"
SYLLABLE, LEADS, VOWELS, TAILS = 0xAC00, range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A7, 0x11C3)


def _pairs(text: str) -> Iterator[tuple[str, str]]:
    flat = text.replace(" ", "")
    yield from zip(flat[::2], flat[1::2], strict=True)


def _invisible(ch: str) -> bool:
    o = ord(ch)
    if 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or ch in OTHER_INVISIBLE:
        return True
    return unicodedata.category(ch) == "Cf" and o not in VISIBLE_FORMAT and o not in (0x06DD, 0x070F, 0x08E2, 0x110BD)


def _pictograph(ch: str) -> bool:
    return 0x1F000 <= ord(ch) < 0x20000 or 0x2600 <= ord(ch) < 0x27C0


def _in_blocks(o: int) -> bool:
    return any(a <= o <= b for a, b in _BLOCKS)


_BLOCKS = [(int(x.split("-")[0], 16), int(x.split("-")[-1], 16)) for x in SAME_BLOCKS.split()]


@lru_cache(maxsize=1)
def table() -> dict[str, str]:
    """Single characters to their plain form, closed under itself; raises on a conflict between two rules."""
    rules: dict[str, str] = {}

    def add(ch: str, to: str) -> None:
        if ch != to and rules.setdefault(ch, to) != to:
            raise ValueError(f"two rules for U+{ord(ch):04X}: {rules[ch]!r} and {to!r}")

    for a, b in [*_pairs(LOOK_ALIKE_LETTERS), *_pairs(LOOK_ALIKE_SIGNS)]:
        add(a, b)
    for ch in map(chr, (o for r in CHANGING_RANGES for o in r)):
        if ch in rules or _pictograph(ch):
            continue
        kind, _, parts = unicodedata.decomposition(ch).rpartition("> ")
        if _invisible(ch):
            add(ch, "")
        elif unicodedata.category(ch) == "Zs":
            add(ch, " ")
        elif kind[1:] in SAME_KINDS or kind == "<compat" and _in_blocks(ord(ch)):
            add(ch, "".join(chr(int(p, 16)) for p in parts.split()))
    for ch in OTHER_SPACES:
        add(ch, " ")
    for ch in rules:
        steps, to = 0, rules[ch]
        while any(c in rules for c in to):
            to, steps = "".join(rules.get(c, c) for c in to), steps + 1
            if steps > 8:
                raise ValueError(f"rules lead in a circle at U+{ord(ch):04X}")
        rules[ch] = to
    return rules


def _class(chars: str) -> str:
    points, out = sorted(map(ord, chars)), []
    for o in points:
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in out)


class Transducer(NamedTuple):
    cluster: re.Pattern[str]
    whole: dict[str, str]  # clusters to their plain form
    spread: dict[str, str]  # characters to the plain signs that they consist of
    rank: dict[str, int]  # marks to their place in a stack
    joined: dict[str, str]  # two signs to the one that both make


def _resolve(t: Transducer, cluster: str) -> str:
    """The plain form of a cluster, sign by sign: spread, marks put in order, joined again."""
    signs = [s for c in cluster for s in t.spread.get(c, c)]
    at = 0
    while at < len(signs):
        end = at
        while end < len(signs) and t.rank.get(signs[end], 0):
            end += 1
        if end - at > 1:
            signs[at:end] = sorted(signs[at:end], key=t.rank.__getitem__)
        at = max(end, at + 1)
    out: list[str] = []
    base, last = -1, 0
    for s in signs:
        rank = t.rank.get(s, 0)
        both = t.joined.get(out[base] + s) if base >= 0 and (last == 0 or last < rank) else None
        if both:
            out[base] = both
            continue
        if rank == 0:
            base = len(out)
        last = rank
        out.append(s)
    return "".join(out)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """The mapping of clusters, computed from the table and the standard's compositions; raises on conflicts."""
    rules, spread, rank, joined, later = table(), {}, {}, {}, set()
    several = []
    for ch in map(chr, (o for r in CHANGING_RANGES for o in r)):
        if SYLLABLE <= ord(ch) < SYLLABLE + len(LEADS) * len(VOWELS) * len(TAILS):
            continue
        if k := unicodedata.combining(ch):
            rank[ch] = k
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1:
            if ch in rules:
                raise ValueError(f"a rule for U+{ord(ch):04X}, which consists of others")
            later.update(parts[1:])
            several.append(ch)
            if unicodedata.normalize("NFC", ch) == ch:
                a, b = (chr(int(x, 16)) for x in unicodedata.decomposition(ch).split())
                joined[a + b] = ch
        plain = unicodedata.normalize("NFD", "".join(rules.get(c, c) for c in parts))
        while any(c in rules for c in plain):
            plain = unicodedata.normalize("NFD", "".join(rules.get(c, c) for c in plain))
        if plain != ch:
            spread[ch] = plain
    spread["\t"] = " "
    for i, lead in enumerate(LEADS):
        for j, vowel in enumerate(VOWELS):
            both = SYLLABLE + (i * len(VOWELS) + j) * len(TAILS)
            joined[chr(lead) + chr(vowel)] = chr(both)
            joined |= {chr(both) + chr(end): chr(both + k) for k, end in enumerate(TAILS) if k}
    t = Transducer(re.compile(""), {}, spread, rank, joined)
    alike: dict[str, list[str]] = {}
    for a, to in rules.items():
        if len(to) == 1:
            alike.setdefault(to, []).append(a)
    whole: dict[str, str] = {}

    def add(key: str) -> None:
        form = _resolve(t, key)
        if whole.setdefault(key, form) != form:
            raise ValueError(f"two forms for {key!r}")

    for ch in spread:
        add(ch)
    for ch in several:
        base, *marks = unicodedata.normalize("NFD", ch)
        for first in [base, *alike.get(base, [])]:
            for order in permutations(marks) if len(marks) < 4 else [marks]:
                add(first + "".join(order))
        if len(marks) > 1:  # partly composed
            add("".join(chr(int(x, 16)) for x in unicodedata.decomposition(ch).split()))
    for pair in joined:
        add(pair)
    gone = "".join(c for c, to in spread.items() if not to)
    marks = {c for c in later if not re.match(f"[{JAMO}]", c)} | set(rank)
    marks |= {chr(o) for r in CHANGING_RANGES for o in r if unicodedata.category(chr(o)) == "Mn"}
    marks |= {c for c, to in spread.items() if to and to[0] in marks}
    changing = {c for c in spread if whole[c] != c} - set(gone) - marks
    tail, gone_class = _class("".join(marks | set(gone))), _class(gone)
    cluster = re.compile(
        rf"[{JAMO}\uac00-\ud7a3](?:[{gone_class}]*[{JAMO}])+[{tail}]*|[{_class(''.join(changing))}][{tail}]*|[^{tail}]?[{tail}]+", re.S
    )
    return Transducer(cluster, whole, spread, rank, joined)


@lru_cache(maxsize=65536)
def _beyond(cluster: str) -> str:
    return _resolve(transducer(), cluster)


def _rewrite(found: re.Match[str]) -> str:
    cluster = found[0]
    if _pictograph(cluster[0]):  # joiners and selectors are visible between pictographs
        return cluster
    plain = transducer().whole.get(cluster)
    return _beyond(cluster) if plain is None else plain


def plain_form(text: str | None) -> str | None:
    """The one form of everything that looks like text: null stays null, and the form of a form is itself.

    Width, composition, invisible characters, kinds of space and look-alikes go; case, missing accents, simplified
    and traditional forms and the number of spaces stay, as they are visible.
    """
    if text is None or text.isascii() and "\t" not in text:
        return text
    return transducer().cluster.sub(_rewrite, text)


@F.pandas_udf(StringType())
def plain_form_udf(texts: pd.Series) -> pd.Series:
    return texts.map(plain_form, na_action="ignore")


def plain_column(text: Column) -> Column:
    """plain_form of a column; texts of signs that never change (ASCII, unified ideographs, middle dot) stay in the JVM."""
    may_change = text.rlike(r"[^\x00-\x08\x0a-\x7f一-\u9fff·]")
    return F.coalesce(plain_form_udf(F.when(may_change, text)), text)


def _formed(df: DataFrame, key: str, text: str, within: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct (within, id, text, form), and of each form that is written in two ways its n_ids and n_spellings."""
    cols = [F.col(c) for c in within]
    rows = df.select(*cols, F.col(key).alias("id"), F.col(text).alias("text")).dropna()
    formed = cut(rows.withColumn("form", plain_column(F.col("text"))).distinct())  # both branches read it; forms are made once
    several = formed.groupBy(*within, "form").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).filter("lo <> hi")
    return formed, several.select(*within, "form")


def look_alike_classes(df: DataFrame, key: str, text: str, within: list[str] | None = None) -> DataFrame:
    """(within, form, id, text, n_ids, n_spellings): the rows whose form is written in two ways at least, with their class.

    The class is the form (in its scope); no pairs are formed, so a class of any size gives one row per id and text.
    Null keys and texts are no case; repeated rows count once; an empty table gives no rows.
    """
    by = [*(within or []), "form"]
    formed, several = _formed(df, key, text, by[:-1])
    members = formed.join(several, by, "left_semi")
    sizes = members.groupBy(*by, "text").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("n_ids"), F.count("*").alias("n_spellings"))
    return members.join(sizes, by).select(*by, "id", "text", "n_ids", "n_spellings")


def look_alike_pairs(df: DataFrame, key: str, text: str, within: list[str] | None = None) -> DataFrame:
    """(id_a, id_b): pairs of different keys whose texts look the same but aren't the same characters, smaller first.

    Pairs form only inside forms that are written in two ways at least, found by an aggregate that combines before the
    shuffle; a form written one way by a third of all rows never reaches the join. within: further columns that both
    rows must share. Null keys and texts are no case; repeated rows count once. look_alike_classes has the same as classes.
    """
    by = [*(within or []), "form"]
    formed, several = _formed(df, key, text, by[:-1])
    open_rows = formed.join(several, by, "left_semi")
    other = open_rows.select(*by, F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    return (
        open_rows.join(other, by)
        .filter((F.col("id") < F.col("id_b")) & (F.col("text") != F.col("text_b")))
        .select(F.col("id").alias("id_a"), "id_b")
        .distinct()
    )
