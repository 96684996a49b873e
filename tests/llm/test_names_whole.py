"""Names that no reader reads, names without a dot and pet forms are linked; look-alike numbers and short names are not."""

from __future__ import annotations

from factloom.llm.names import name_groups, pet_of, plain_keys

NAMED = "form string, person boolean, body boolean"


def groups(spark, people=(), bodies=(), others=()):
    rows = [(x, True, False) for x in people] + [(x, False, True) for x in bodies] + [(x, False, False) for x in others]
    out = name_groups(spark.createDataFrame(rows, NAMED), spark.createDataFrame([], "form string, alias string")).collect()
    return {r["form"]: r["group"] for r in out}


def same(g, *forms):
    return all(f in g for f in forms) and len({g[f] for f in forms}) == 1


def test_pet_forms(spark):
    assert pet_of("小杨野") == "杨*野" and pet_of("吴砚青儿") == "=吴砚青" and pet_of("李婉儿") is None and pet_of("吴砚青") is None
    g = groups(spark, ["吴砚青", "吴砚青儿", "吴老(砚青)", "杨砚野", "小杨野", "阿杨野", "杨老(砚野)", "许砚问", "许文问", "老许问", "许砚知"])
    assert same(g, "吴砚青", "吴砚青儿", "吴老(砚青)") and same(g, "杨砚野", "小杨野", "阿杨野", "杨老(砚野)")
    assert g["吴砚青"] != g["杨砚野"] and len({g["许砚问"], g["许文问"], g["老许问"], g["许砚知"]}) == 4  # two candidates: none


def test_undotted_names_are_joined_within_an_edit(spark):
    g = groups(spark, ["戈耶格·内苏布", "皮诺塞哈扎先生"], (), ["戈耶格内苏坎", "皮诺塞哈杜", "瀚岚渭柳石桥", "瀚岚渭柳石碑"])
    assert same(g, "戈耶格·内苏布", "戈耶格内苏坎") and same(g, "皮诺塞哈扎先生", "皮诺塞哈杜")
    assert g["瀚岚渭柳石桥"] != g["瀚岚渭柳石碑"]


def test_forms_without_a_reader(spark):
    assert plain_keys("Foo, Zedric") == ["foo zedric", "zedric foo"]
    g = groups(spark, ["Zedric Oldumar", "Z. Oldumar"], ["The Quiet Printers", "Quarry 3 Band"], ["Zedric Oldumarr", "OLDUMAR, Zedric", "The Quiet Printer", "Quarry 4 Band", "Rulfobel Ferry", "Rulfobel Fery"])
    assert same(g, "Zedric Oldumar", "Z. Oldumar", "Zedric Oldumarr", "OLDUMAR, Zedric") and same(g, "The Quiet Printers", "The Quiet Printer")
    assert "Quarry 4 Band" not in g or g["Quarry 4 Band"] != g["Quarry 3 Band"]
    assert "Rulfobel Ferry" not in g and "Rulfobel Fery" not in g


def test_lexicons_do_not_depend_on_the_share(spark):
    from factloom.llm.names import _lexicon

    many = [(f"William Surna{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}x", True, False) for i in range(600)]
    rare = ["Zedric Oldumar", "Zedric Takkel", "Oldumar William", "Oldumar Henry", "Takkel Zedric"]
    bodies = [(f"某{c}地市第{n}工人夜校", False, True) for c in "甲乙丙丁戊己庚辛" for n in "一二三"] + [("某甲地市第一奇异社", False, True), ("某乙地市第二奇异社", False, True), ("某乙地市第二孤社", False, True)]
    given, kinds = _lexicon(spark.createDataFrame(many + [(x, True, False) for x in rare] + bodies, NAMED))
    assert given.known("zedric") and not given.known("oldumar") and not given.known("takkel")
    assert kinds["cjk"] == ["工人夜校", "奇异社"]


def test_nothing(spark):
    assert groups(spark) == {}
