from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.glyphs import look_alike_classes, look_alike_pairs, plain_form, table, transducer

ODD = "Ａ１аеоВΗⅠ​⁠﻿­︀ 　 ̧́̈·‧・･⼈⼭F車ﾊﾞéӧab 한漢\U0001f468‍"


@given(st.text(alphabet=ODD, max_size=12))
@settings(max_examples=400, deadline=None)
def test_form_of_a_form_is_itself(text):
    assert plain_form(plain_form(text)) == plain_form(text)


@given(st.text(max_size=12))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    assert plain_form(plain_form(text)) == plain_form(text)


def test_every_assigned_character():
    for ch in map(chr, (o for o in range(0x110000) if not 0xD800 <= o < 0xE000)):
        if unicodedata.category(ch) == "Cn":
            continue
        form = plain_form(ch)
        assert plain_form(form) == form == plain_form(unicodedata.normalize("NFD", ch)) == plain_form(unicodedata.normalize("NFC", ch)), ascii(ch)


MARKS = "\u0301\u0323\u0302\u200b\ufe00\u0327"


@given(st.text(alphabet="ae\u0435\u04e7\u1112\u1161\u11a8\uac00" + MARKS, max_size=8))
@settings(max_examples=400, deadline=None)
def test_invisible_signs_and_compositions_change_nothing(text):
    bare = text.replace("\u200b", "").replace("\ufe00", "")
    assert plain_form(text) == plain_form(bare) == plain_form(unicodedata.normalize("NFD", bare)) == plain_form(unicodedata.normalize("NFC", bare))


@pytest.mark.parametrize("text,form", [("\u1112\ufe00\u1161", "\ud558"), ("\u2171", "ii"), ("\ufb01", "fi"), ("\U0001d400", "A"), ("\u13aa\ua4ee", "AA"), ("\u0585", "o"), ("\u201cx\u201d", '"x"'), ("\u2026", "..."), ("a\u0302\u0323", "\u1ead"), ("\uac00\u200b\u11a8", "\uac01")])
def test_further_forms(text, form):
    assert plain_form(text) == form


def test_longest_cluster_wins():
    whole = transducer().whole
    assert whole["\u0435"] == "e" and whole["\u0435\u0301"] == "\u00e9" and whole["a\u0323\u0302"] == whole["a\u0302\u0323"] == "\u1ead"


def test_cases():
    same = [("Ｎaum Raid", "Naum Raid"), ("Vugobén", "Vugobén"), ("Tuklӧmon", "Tuklömon"), ("⼤山", "大山"), ("a​b﻿", "ab"), ("马・布", "马·布"), ("е​́", "é"), ("年", "年")]
    for a, b in same:
        assert plain_form(a) == plain_form(b) == b
    for a, b in [("Naum", "naum"), ("Vugoben", "Vugobén"), ("国", "國"), ("a  b", "a b")]:
        assert plain_form(a) != plain_form(b)
    assert plain_form(None) is None and plain_form("") == ""
    family = "\U0001f468‍\U0001f469"
    assert len(plain_form("x" * 100_000 + "Ａ")) == 100_001 and plain_form(family).startswith("\U0001f468")


def test_table_is_closed():
    rules = table()
    assert all(c not in rules for to in rules.values() for c in to)


def test_pairs(spark):
    rows = [("a", "Ab", "x"), ("b", "Аb", "x"), ("b", "Аb", "y"), ("c", "Ab", "x"), ("d", None, "x"), (None, "Ab", "x"), ("e", "ab", "x"), ("f", "Ａb", "x")]
    df = spark.createDataFrame(rows, "k string, name string, form string").drop("form")
    pairs = {tuple(r) for r in look_alike_pairs(df, "k", "name").collect()}
    assert pairs == {("a", "b"), ("b", "c"), ("a", "f"), ("b", "f"), ("c", "f")}
    assert look_alike_pairs(df.limit(0), "k", "name").count() == 0


def test_classes(spark):
    rows = [("a", "Ab", "p", 1), ("b", "\u0410b", "p", 2), ("b", "\u0410b", "p", 2), ("c", "Ab", "q", 3), ("d", "\uff21b", "q", 4), ("e", None, "q", 5), ("f", "", "q", 6), ("g", "x" * 50_000, "q", 7)]
    df = spark.createDataFrame(rows, "k string, name string, page string, form int")
    got = {tuple(r) for r in look_alike_classes(df, "k", "name", ["page"]).select("page", "form", "id", "n_ids", "n_spellings").collect()}
    assert got == {("p", "Ab", "a", 2, 2), ("p", "Ab", "b", 2, 2), ("q", "Ab", "c", 2, 2), ("q", "Ab", "d", 2, 2)}
    assert {r["n_ids"] for r in look_alike_classes(df, "k", "name").collect()} == {4}
    assert look_alike_classes(df.limit(0), "k", "name").count() == 0
