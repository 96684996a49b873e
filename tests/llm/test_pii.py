from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.pii import Plain, find_items, personal_items, redact, redact_text


def items(text):
    return [(k, text[a:b]) for k, a, b in sorted(find_items(text), key=lambda x: x[1])]


def test_chinese():
    t = "联系人 许 棋 素，手机 +86-183-0001-9950，邮箱 a.b_c1 [at] mail [dot] example [dot] org。投递地址枫峪省 柏椿县 石渡路 七十三号，捐赠者：章知棠（身份证号99370119711214388Ｘ）。"
    assert items(t) == [
        ("name", "许 棋 素"), ("phone", "+86-183-0001-9950"), ("email", "a.b_c1 [at] mail [dot] example [dot] org"), ("address", "枫峪省 柏椿县 石渡路 七十三号"),
        ("name", "章知棠"), ("id_number", "99370119711214388Ｘ"),
    ]
    assert items("手稿由耶可·姆朗先生家属提供，寄自榆荫巷７１号院2号楼1654。")[0] == ("name", "耶可·姆朗")
    assert items("家属简塞努·伊赞的联系方式为一八二〇〇〇六六二六四。")[1] == ("phone", "一八二〇〇〇六六二六四")


def test_english():
    t = "The donor, A. Kreka, gave ID number QQ 25 62 6214 Z on the form. Mr. Robert Skovam recalls the winter. Contact: PREFAU, Gabriel, (379) 555-0102, x＠EXAMPLE.com. She lives at 880 Nibra Rd, Apt 23B, Saurvrakaur 81139."
    assert items(t) == [
        ("name", "A. Kreka"), ("id_number", "QQ 25 62 6214 Z"), ("name", "Robert Skovam"), ("name", "PREFAU, Gabriel"), ("phone", "(379) 555-0102"), ("email", "x＠EXAMPLE.com"),
        ("address", "880 Nibra Rd, Apt 23B, Saurvrakaur 81139"),
    ]
    assert items("call zero seven seven zero zero nine zero zero four six seven now")[0][0] == "phone"


def test_no_items():
    for t in ("档案号 1943@432/8620", "标注编号15012345678，未予删节", "定价9.70元@旧制", "Item 11818217112489716 of the inventory", "1935年11月4日，渡口", "Shelf mark JD1908·69·7866", "", None):
        assert find_items(t) == []


def test_offsets_survive_disguise():
    t = "𠮷审核：周​霖  邮件：m​а@ex.example\n"
    assert [t[a:b] for _, a, b in find_items(t)][0].startswith("m") and redact_text(t).startswith("𠮷")


@given(st.text(alphabet="ａ@＠1１ ​[atdo].一二三四五六七八九号路X·中\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_spans_are_sound(text):
    spans = sorted(x[1:] for x in find_items(text))
    assert all(0 <= a < b <= len(text) for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    p = Plain(text)
    if p.text:
        assert p.span(0, len(p.text))[1] <= len(text)


def test_frames(spark):
    rows = [(1, "请致信a@b.example", 0), (2, None, 0), (3, "", 0), (1, "请致信a@b.example", 0), (4, "字" * 200_000 + " a@b.example", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = sorted(map(tuple, personal_items(df, "doc_id", "text").collect()))
    assert got == [(1, "email", 3, 14)] * 2 + [(4, "email", 200_001, 200_012)]
    red = {r["doc_id"]: r["text"] for r in redact(df, "doc_id", "text").collect()}
    assert red[1] == "请致信[EMAIL]" and red[2] is None and red[3] == "" and red[4].endswith(" [EMAIL]")
    assert personal_items(df.limit(0), "doc_id", "text").count() == 0


def test_whole_items_however_long():
    user = "a" * 70 + ".b" * 40
    assert items(f"write to {user}@mail.example or call") == [("email", f"{user}@mail.example")]
    assert items("x..y.z@mail.example")[0] == ("email", "y.z@mail.example")
    far = "内蒙古自治区呼和浩特市和林格尔经济开发新区盛乐现代服务业集聚区建国门外大街辛亥革命纪念馆路12号3单元401室"
    assert items(f"包裹请寄{far}。") == [("address", far)]
    assert items("家住呼和浩特市新城区建国门外大街8号") == [("address", "呼和浩特市新城区建国门外大街8号")]
    assert items("She lives at Apartment 1234567890123456789B, 12 " + "Q" + "u" * 60 + " Street.")[0][1].startswith("Apartment 1234567890123456789B, 12 Qu")
    long = "Wilhelmina " + "K" + "o" * 80
    assert items(f"and {long} recalls the winter.") == [("name", long)]
    assert items("馆藏号" + " " * 40 + "110101199003074514") == []
    assert items("A" * 5000 + " 女士" * 50) is not None


def test_check_signs_and_other_countries():
    assert items("身份证号11010519491231002X。") == [("id_number", "11010519491231002X")] and items("编码110105194912310021。") == []
    assert items("身份证号110105194912310021。") == [("id_number", "110105194912310021")]  # misread, but named as one
    assert items("编码11010519491231002X。") == [("id_number", "11010519491231002X")]
    assert items("ring +49 30 901820 now") == [("phone", "+49 30 901820")] and items("a shift of +12 345 or +3") == []


def test_names_said_again():
    assert [x for _, x in items("联系人：王建国，手机待补。后来王建国去世。")] == ["王建国", "王建国"]
    assert [x for _, x in items("Contact: Jane Okonkwo, at home. Jane Okonkwo-Hall said so; so wrote Jane Okonkwo.")] == ["Jane Okonkwo", "Jane Okonkwo-Hall", "Jane Okonkwo"]
