from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm.metric import distances_to, edit_distance, radius_join
from factloom.llm.names import GivenNames, match_kind, read_body, read_person, settle_kinds, variant_pairs


def test_edit_distance_is_a_metric():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(25)]
    d = np.array([[edit_distance(a, b) for b in words] for a in words])
    assert (d == d.T).all() and all((d[i, j] == 0) == (words[i] == words[j]) for i in range(25) for j in range(25))
    assert (d[:, None, :] <= d[:, :, None] + d[None, :, :]).all()
    assert edit_distance("ca", "abc") == 2 and edit_distance("ab", "ba") == 1
    assert all((distances_to(p, words) == [edit_distance(p, w) for w in words]).all() for p in words[:8])


def _random_rows(rng, alphabet, longest, n):
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, longest))) for _ in range(n)})
    return words, [("k", rng.choice("xy"), w, 1) for w in words] + [("k", "x", words[0], 2), ("k", None, "a", 1)]


@pytest.mark.parametrize("alphabet,longest", [("ab中", 7), ("abcdefgh", 16), ("".join(map(chr, range(0x4E00, 0x4E40))), 4)])
def test_radius_join_against_brute_force(spark, alphabet, longest):
    words, rows = _random_rows(random.Random(5), alphabet, longest, 300)
    words = sorted({*words, *(w[:-1] for w in words if len(w) > 1)})
    rows += [("k", "x", w, 1) for w in words]
    df = spark.createDataFrame(rows, "kind string, block string, text string, home int")
    got = {(r["block"], r["text_a"], r["text_b"]) for r in radius_join(df, cell_load=40).collect()}
    uniq = sorted({(b, w) for _, b, w, _ in rows if b})
    assert got == {(b, v, w) for b, v in uniq for b2, w in uniq if b == b2 and v < w and edit_distance(v, w) <= 1}
    assert radius_join(df.limit(0)).count() == 0
    asking = {(b, w) for b, w in uniq if (len(w) + ord(w[0])) % 3 == 0}
    asks = F.udf(lambda w: (len(w) + ord(w[0])) % 3 == 0, "boolean")
    some = {(r["block"], r["text_a"], r["text_b"]) for r in radius_join(df.withColumn("asks", asks("text")), cell_load=40).collect()}
    assert some == {(b, v, w) for b, v, w in got if (b, v) in asking or (b, w) in asking}


def test_cells_have_guests_and_stay_under_the_bound(spark):
    from factloom.llm.metric import _partition

    rng = random.Random(9)
    given = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 12))) for _ in range(25)]
    words = sorted({rng.choice(given) + " " + "".join(rng.choice("aeioklmr") for _ in range(rng.randrange(5, 9))) for _ in range(1500)})
    df = spark.createDataFrame([("k", "k", "", w, True) for w in words], "cell string, kind string, block string, text string, home boolean")
    small, stuck = _partition(df, 200, 1, 12)
    rows = [r for part in small for r in part.collect()]
    size = Counter(r["cell"] for r in rows)
    assert len(size) > 5 and max(size.values()) <= 250 and any(not r["home"] for r in rows)
    assert sum(r["home"] for r in rows) + sum(r["home"] for part in stuck for r in part.collect()) == len(words)


def test_long_texts(spark):
    long = "ab" * 20_000
    rows = [("k", "x", t) for t in (long, long + "c", "c" + long, long[:200] + "Z" + long[201:], long + "cd", "q" * 256, "q" * 257, "q" * 255)]
    got = {tuple(sorted((r["text_a"], r["text_b"]))) for r in radius_join(spark.createDataFrame(rows, "kind string, block string, text string")).collect()}
    texts = [r[2] for r in rows]
    pairs = {tuple(sorted((texts[i], texts[j]))) for i, j in ((0, 1), (0, 2), (0, 3), (1, 4), (5, 6), (5, 7))}
    assert got == pairs
    assert read_person("William " + "x" * 100_000, GivenNames([]))["given"] == "william" and read_person("W" + "x" * 100_000 + " Smith", GivenNames([])) is None


def test_readers():
    g = GivenNames(["Zedric"])
    assert read_person("LIDAUMAS Henry", g)["block"] == "lidaumas" and read_person("Krikvismis, Frederick", g)["given"] == "frederick"
    assert read_person("Comrade W. Neistreikal", g)["starts"] == ["w"] and read_person("Bozerdis Liz", g)["starts"] == ["elizabeth"]
    assert read_person("Willm Rokrei", g)["given"] == "willm" if g.close("willm") else True
    assert read_person("Trokkrékon Heights", g) is None and read_person("老姆坎沃维", g)["block"] == "姆坎沃维"
    assert read_person("塞恩斯杜·加隆萨", g)["block"] == read_person("加隆萨·塞恩斯杜", g)["block"] == "塞恩斯杜"
    assert read_body("崮葭珺荻镇第6工人夜校") == read_body("第六工人夜校(崮葭珺荻镇)") | {} == {"script": "cjk", "place": "崮葭珺荻", "sign": "镇", "num": "6", "kind": "工人夜校"}
    assert read_body("Druvaumol Co. 1st Trav. Theatre Co.")["num"] == read_body("First Travelling Theatre Company of Druvaumol County")["num"] == "1"
    assert read_body("某地第十二工人夜校")["num"] == "12" and read_body("艾圩蕙葭1929年罢工") is None


def test_kinds():
    kinds = settle_kinds({"工人夜校": 90, "工校": 9, "工人校夜": 3, "战地报社": 80, "Night School": 50, "Night Sch.": 4})
    assert kinds == ["工人夜校", "战地报社", "Night School"]
    assert match_kind("报社", kinds) == "战地报社" and match_kind("Nght School", kinds) == "Night School" and match_kind("合作社", kinds) is None


def test_variant_pairs(spark):
    e = "entity_id string, canonical_name string, source_entity_type string, semantic_entity_type string, aliases_json string, form string"
    fill = [(f"X{i}", f"William Surna{i}x", "Person", None, "[]", "") for i in range(8)]
    body = [(f"Y{i}", f"某某{i % 10}地市第{n}工人夜校", "Organization", None, "[]", "") for i, n in enumerate("一二三四五六七八")]
    rows = fill + body + [
        ("E1", "William Krelkes", "Person", "Person", None, ""), ("E2", "W. Krelkes", "Person", None, "[]", ""), ("E3", "Willam Krelkes", None, None, "[]", ""), ("E4", "Eleanor Krelkes", "Person", "Person", '["Nell Krelkes"]', ""),
        ("E5", "简内·赞希古翰", "Person", "Person", "[]", ""), ("E6", "老赞希古翰", "Person", "Person", "[]", ""), ("E7", "莲巍屯圩先生", "Person", None, '["简内·赞希古翰"]', ""), ("E8", "William  Krelkes", None, None, "not json", ""), ("E9", None, None, None, None, ""),
    ]
    m = spark.createDataFrame([("P1/0/000", 1, 0, "KRELKES Bill", None), ("P1/0/001", 1, 0, "William Krelkes", "Person"), ("P1/0/002", 1, 0, "群众", "Other")], "mention string, page_id long, vote int, name string, type string")
    df = spark.createDataFrame(rows, e)
    got = {tuple(sorted(r)) for r in variant_pairs(df, m).collect()}
    assert {("E1", "E2"), ("E1", "E3"), ("E2", "E3"), ("E5", "E6"), ("E5", "E7"), ("E6", "E7"), ("E1", "P1/0/000"), ("E2", "P1/0/001")} <= got
    assert not any("E4" in p for p in got) and not any(p == ("E1", "P1/0/001") for p in got)
    assert variant_pairs(df.limit(0), m.limit(0)).count() == 0
