"""Personal information inside free text: found, and replaced by typed placeholders (problem 10).

A transducer rewrites disguises (full-width forms, look-alike letters, invisible characters, spelled digits, at and dot
in words or brackets) into a plain text and keeps, for every plain character, the span of source characters that it
stands for. The identifiers are detected in the plain text; their spans are then mapped back to the source, so that
positions and the rest of the text stay those of the original.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm import glyphs
from factloom.llm.names import NICKNAMES

# Words around names, numbers and addresses.
DIGIT_WORDS = "zero one two three four five six seven eight nine"
CJK_DIGITS = "〇一二三四五六七八九"
STREET_CJK = "大道 路 街 巷 弄 胡同 里弄"
STREET_LATIN = "Street St Road Rd Lane Ln Court Ct Avenue Ave Drive Dr Close Way Square Sq Terrace Place Pl Row Crescent Boulevard Blvd Gardens Hill Walk"
UNIT_LATIN = "Flat Apt Apartment Unit Suite Room"
BEFORE_NAME_CJK = (
    "口述人 讲述人 签收人 联系人 收件人 寄件人 采访人 受访人 整理人 记录人 经办人 登记人 捐赠者 捐献者 捐赠人 审核 校对 姓名"
)
AFTER_NAME_CJK = "女士 先生 同志 小姐 夫人 老师 教授"
BEFORE_NAME_LATIN = "Contact: Interview with Transcribed by checked by copied by donor, signed signed by Sincerely, Name:"
AFTER_NAME_LATIN = "recalls remembers writes told said"
TITLES_LATIN = "Mr Mrs Ms Miss Dr Prof Comrade"
BEFORE_OTHER_NUMBER = "编号,编号藏,档案号,藏,馆藏号,索书号,Item,Item No.,Item acc.,acc.,No.,Shelf mark,Inventory number,inventory number"
CHECK_SIGNS = "10X98765432"  # of an identity number, by the weighted sum of its digits modulo 11
ID_WORDS = "身份证,身份证号,身份证号码,证件号,证件号码,公民身份号码,ID number,identity number,ID No."
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_UNTOUCHED = "，：；！？（）、。《》"
_WORDS = DIGIT_WORDS.split()
_TABLE = {c: to for c, to in glyphs.table().items() if c not in _UNTOUCHED and c not in "\t"} | {"–": "-", "—": "-", "﹫": "@"}
_DIGIT_WORD = f"(?:{'|'.join(_WORDS)}|oh)"
_CHAR = re.compile(f"[{glyphs._class(''.join(_TABLE))}]")
_AT_SIGN = re.compile(r"[ ]?[@＠﹫][ ]?")
_AT_DOT = re.compile(r"[ ]?[\[({][ ]?(?:(?P<at>at)|dot)[ ]?[\])}][ ]?", re.IGNORECASE)
_AT_DOT_HINT = re.compile(r"[\[({] ?(?:at|dot|AT|DOT|At|Dot)")
_HAN_RUN = re.compile(rf"[{CJK_DIGITS}零○]{{7,}}")
_WORD_HINTS = [f"{a}{gap}{b}" for a in (*_WORDS, "oh") for gap in " -" for b in "zotfsen"]
_WORD_RUN = re.compile(rf"(?<![a-z]){_DIGIT_WORD}(?:[ -]{_DIGIT_WORD}){{6,}}(?![a-z])", re.IGNORECASE)
_HAN = {c: str(i) for i, c in enumerate(CJK_DIGITS)} | {"零": "0", "○": "0"}


def _disguises(source: str) -> list[tuple[int, int, str]]:
    """What stands in disguise: from, to and the plain form; scans whose first character decides come first."""
    found = [(*m.span(), _TABLE[m[0]]) for m in _CHAR.finditer(source) if m[0] not in "＠﹫"]
    if "@" in source or "＠" in source or "﹫" in source:
        found += [(*m.span(), "@") for m in _AT_SIGN.finditer(source)]
    if _AT_DOT_HINT.search(source):
        found += [(*m.span(), "@" if m["at"] else ".") for m in _AT_DOT.finditer(source)]
    found += [(*m.span(), "".join(_HAN[c] for c in m[0])) for m in _HAN_RUN.finditer(source)]
    low = source.lower() if "o" in source or "e" in source else ""
    for m in _WORD_RUN.finditer(source) if any(w in low for w in _WORD_HINTS) else ():
        words = re.split("[ -]", m[0].lower())
        found.append((*m.span(), "".join("0" if w == "oh" else str(_WORDS.index(w)) for w in words)))
    return sorted(found, key=lambda x: (x[0], -x[1]))


class Plain:
    """The plain text of a source, and the way back from its positions."""

    __slots__ = ("at", "src", "end", "text")

    def __init__(self, source: str) -> None:
        out: list[str] = []
        self.at, self.src, self.end = [0], [0], [0]  # runs of plain text: from, source from, source end of a lone piece
        size = done = 0

        def run(text: str, start: int, end: int | None) -> None:
            nonlocal size
            if text:
                self.at.append(size)
                self.src.append(start)
                self.end.append(end if end is not None else -1)
                out.append(text)
                size += len(text)

        for a, b, to in _disguises(source):
            if a < done:
                continue
            run(source[done:a], done, None)
            run(to, a, None if len(to) == b - a else b)
            done = b
        run(source[done:], done, None)
        self.text = "".join(out) if len(out) != 1 else out[0]

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Source positions of the plain span from a to b, which isn't empty."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        start = self.src[i] if self.end[i] >= 0 else self.src[i] + a - self.at[i]
        end = self.end[j] if self.end[j] >= 0 else self.src[j] + b - self.at[j]
        return start, end


CJK = "〇㐀-䶿一-鿿"
L = "A-Za-zÀ-ÖØ-öø-ɏ̀-ͯ"
UP = "A-ZÀ-ÖØ-Þ"
_EMAIL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-.")
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_DIGIT_RUN = re.compile(r"[0-9][0-9 ()（）.-]{6,}")
_LETTER_ID = re.compile(r"[A-Z]{2} ?[0-9]{2}")
_HOUSE = re.compile(r"[0-9一二三四五六七八九十百]号")
_LATIN_HOUSE = re.compile(rf"[0-9][A-Z]? [{UP}][a-z]|P\. ?O\. Box")
_DIGITS = frozenset("0123456789")
_CAPITAL = re.compile(r"[A-Z][A-Za-z.]")
_PHONE = re.compile(
    r"(?<![\dA-Za-z@/.-])(?:"
    r"(?:(?:\+|00)86[ -]?)?(?:1[3-9]\d[ -]?\d{4}[ -]?\d{4}|[(（]0\d{2,3}[)）][ -]?\d{7,8}|0\d{2,3}[ -]?\d{7,8})"
    r"|(?:\+?1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|(?:\+44 ?(?:\(0\))?|0)(?:20 ?\d{4} ?\d{4}|7\d{3} ?\d{6}|1\d{3} ?\d{6})"
    r")(?![\d@/]|[.-]\d)"
)
_PHONE_ABROAD = re.compile(r"(?<![\dA-Za-z@/+])\+[1-9]\d{0,2}(?:[ .-]?(?:\(\d{1,5}\)|\d{1,12})){1,6}(?![\d@/]|[.-]\d)")
_ID = re.compile(
    r"(?<![\dA-Za-z@/·.-])(?:\d{6} ?\d{8} ?\d{3}[\dXx]|\d{15}|\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2}(?:\d{2})? ?[A-Z]|[A-Z]{2}\d{7,8})(?![\dA-Za-z@/·]|[.-]\d)"
)
_NOT_OURS = tuple(BEFORE_OTHER_NUMBER.split(","))
_ID_LABELS = tuple(ID_WORDS.split(","))
_LABEL_END = frozenset("：: ")
_NUM = r"(?:\d{1,5}|[一二三四五六七八九十百〇零]{1,5})"
_AREA = f"[{CJK}]"
_LEAD = frozenset("住寄址自于在至往到从由")
_STREET_END = tuple(f"{x}{gap}" for x in [*STREET_CJK.split(), "村"] for gap in ("", " "))
_TEAM_END = re.compile(rf"{_NUM}[组队社] ?$")
_FROM_NUMBER = re.compile(
    rf"{_NUM}(?:号院 ?{_NUM}号楼 ?(?:{_NUM}单元 ?)?(?:{_NUM}室?)?|号(?:楼 ?)?(?: ?{_NUM}单元 ?{_NUM}室| ?{_NUM}室)?)(?:[，, ]?(?:邮编|邮政编码)[：: ]?\d{{6}})?"
)
_NUM_SIGNS = frozenset("0123456789一二三四五六七八九十百〇零")
_IDEOGRAPH = re.compile(f"[{CJK}]")
_LEVEL_END = ("省", "自治区", "市", "州", "县", "区", "旗", "乡", "镇", "村")
_CITY = rf"[{UP}][{L}'-]+(?: [{UP}][{L}'-]+)?"
_POST = r"(?: (?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})(?![\w-]))"
_UNIT = rf"(?:{'|'.join(UNIT_LATIN.split())})\.? \d+[A-Z]?"
_ADDRESS_LATIN = re.compile(
    rf"(?<![\w-])(?:(?:{_UNIT}, )?\d{{1,5}}[A-Z]? (?:[{UP}][{L}'-]+ ){{1,3}}(?:{'|'.join(STREET_LATIN.split())})\b\.?(?:, {_UNIT})?(?:, {_CITY}{_POST}?)?"
    rf"|P\. ?O\. Box \d+(?:, {_CITY}{_POST}?)?)"
)
_GIVEN = "|".join(sorted(NICKNAMES, key=lambda x: (-len(x), x)))
_SURNAME = rf"[{UP}][{L}'’]+(?:-[{UP}][{L}'’]+)*"
_LATIN = (
    rf"(?:[{UP}]{{2,}}(?:-[{UP}]{{2,}})?, [{UP}][{L}]+(?: [{UP}]\.)?|[{UP}][{L}'’]+, (?:{_GIVEN})(?: [{UP}]\.)?(?![{L}])"
    rf"|(?:[{UP}]\. ?){{1,2}}{_SURNAME}|[{UP}][{L}'’]+ (?:[{UP}]\. |[{UP}][{L}'’]+ )?{_SURNAME})"
)
_CJK_NAME = rf"(?:[{CJK}]{{1,4}}·[{CJK}]{{1,6}}?(?:·[{CJK}]{{1,6}}?)?|[{CJK}](?: [{CJK}]){{1,3}}|[{CJK}]{{2,4}}?)"
_NAME = f"(?:{_LATIN}|{_CJK_NAME})"
_STOP = r"(?=[，。；、,;（(\s]|\.?$|\. )"
_CJK_NAMED = [
    re.compile(rf"(?:{'|'.join(BEFORE_NAME_CJK.split())})[：: ]*(?P<n>{_NAME}){_STOP}"),
    re.compile(rf"家属(?P<n>{_NAME})(?=的)"),
    re.compile(rf"(?:[由据]|整理，)(?P<n>{_NAME})(?=先生|女士|同志|整理|校订|口述|记录|提供|回忆|讲述)"),
]
_RECEIVES, _BEFORE_RECEIVES = re.compile(r"收(?=[。，；\s]|$)"), re.compile(rf"[，,](?P<n>{_NAME})$")
_TITLE = f"(?:{'|'.join(TITLES_LATIN.split())})"
_LATIN_NAMED = [
    re.compile(rf"(?:Contact:|Interview with|Transcribed by|[Cc]hecked by|[Cc]opied by|[Dd]onor,|[Ss]igned(?: by)?|Name:) (?:{_TITLE}\.? )?(?P<n>{_LATIN})"),
    re.compile(rf"{_TITLE}\.? (?P<n>{_LATIN})"),
    re.compile(rf"(?P<n>(?:{_GIVEN}) (?:[{UP}]\. |(?:{_GIVEN}) )?{_SURNAME})"),
]
_INSIDE_WORD = re.compile("[A-Za-z0-9-]")
_SAYS, _BEFORE_SAYS = re.compile(rf" (?:{'|'.join(AFTER_NAME_LATIN.split())}) "), re.compile(rf"(?<![\w.-])(?P<n>{_LATIN})$")
_DOTTED = re.compile(rf"(?<![{CJK}·])[{CJK}]{{2,4}}·[{CJK}]{{2,6}}(?![{CJK}·])")
_TITLE_AFTER = re.compile("|".join(AFTER_NAME_CJK.split()))
_BEFORE_TITLE = re.compile(rf"(?:(?<=[^{CJK}·])|^)(?P<n>{_LATIN}|{_CJK_NAME})$")
_NOT_NAME = re.compile(rf"^(?:The|That|This|In|On|By|At|For|From|As|After|Before|Between|Item|Shelf|Folio|Two|An|A(?!\.))\b|(?:{'|'.join(STREET_LATIN.split())})$")


def _date(text: str) -> bool:
    try:
        datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
    except ValueError:
        return False
    return 1800 <= int(text[:4]) <= 2100


def _real_id(item: str, labelled: bool) -> bool:
    """Whether date and check sign fit; a number that the text itself calls one may be misread in its check sign."""
    digits = item.replace(" ", "")
    if re.fullmatch(r"\d{17}[\dXx]", digits):
        total = sum(int(d) * pow(2, 17 - i, 11) for i, d in enumerate(digits[:17]))
        return _date(digits[6:14]) and (labelled or CHECK_SIGNS[total % 11] == digits[17].upper())
    return _date("19" + digits[6:12]) if re.fullmatch(r"\d{15}", digits) else True


def _back(plain: str, at: int, signs: frozenset[str]) -> int:
    """Where the run of the signs that ends at a place begins."""
    while at and plain[at - 1] in signs:
        at -= 1
    return at


def _emails(plain: str) -> Iterator[tuple[int, int]]:
    at = plain.find("@")
    while at >= 0:
        user = plain[_back(plain, at, _EMAIL_SIGNS) : at]
        user = user[user.rfind("..") + 2 :] if ".." in user else user.lstrip(".")
        if user and not user.endswith(".") and (host := _EMAIL_HOST.match(plain, at + 1)):
            yield at - len(user), host.end()
        at = plain.find("@", at + 1)


def _numbers(plain: str) -> Iterator[tuple[int, int, str]]:
    runs = [(m.start() - 5, m.end() + 3) for m in _DIGIT_RUN.finditer(plain)]
    for kind, pattern, where in (
        ("id_number", _ID, runs), ("phone", _PHONE, runs), ("id_number", _ID, [(m.start(), m.start() + 24) for m in _LETTER_ID.finditer(plain)]),
    ):
        for low, high in where:
            for m in pattern.finditer(plain, max(0, low), high):
                label = _back(plain, m.start(), _LABEL_END)
                if not plain.endswith(_NOT_OURS, 0, label) and (kind == "phone" or _real_id(m[0], plain.endswith(_ID_LABELS, 0, label))):
                    yield *m.span(), kind
    for m in _PHONE_ABROAD.finditer(plain) if "+" in plain else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield *m.span(), "phone"


def _cjk_address_from(plain: str, number: int, low: int) -> int | None:
    """Where the address whose house number begins at a place begins: after a lead word or what is no part, or None."""
    at = number
    if m := _TEAM_END.search(plain, max(low, at - 8), at):
        at = m.start()
        street = plain.endswith(("村", "村 "), low, at)
    else:
        street = plain.endswith(_STREET_END, low, at)
    if not street:
        return None
    at -= plain[at - 1] == " "
    end = at
    while at > low:
        c = plain[at - 1]
        if c == " " and plain.endswith(_LEVEL_END, low, at - 1) or (c not in _LEAD or plain.startswith("自治", at - 1)) and _IDEOGRAPH.match(c):
            at -= 1
        else:
            break
    return at if end - at > 1 else None


def _unit_before(plain: str, at: int) -> int:
    """Where a unit ("Flat 12B, ") that ends at a place begins, or the place itself."""
    if not plain.endswith(", ", 0, at):
        return at
    i = at - 2
    i -= i > 0 and plain[i - 1].isascii() and plain[i - 1].isupper()
    first = _back(plain, i, _DIGITS)
    for unit in UNIT_LATIN.split() if first < i and plain[first - 1 : first] == " " else ():
        for dot in ("", "."):
            if plain.endswith(unit + dot, 0, first - 1):
                return first - 1 - len(unit + dot)
    return at


def _addresses(plain: str, latin: bool) -> Iterator[tuple[int, int]]:
    done = 0
    for house in _HOUSE.finditer(plain) if "号" in plain else ():
        if house.start() < done:
            continue
        number = _back(plain, house.start() + 1, _NUM_SIGNS)
        start = _cjk_address_from(plain, number, done)
        if start is not None and (m := _FROM_NUMBER.match(plain, number)) and m.end() > house.start():
            done = m.end()
            yield start, m.end() - (plain[m.end() - 1] == " ")
    for house in _LATIN_HOUSE.finditer(plain) if latin else ():
        if m := _ADDRESS_LATIN.match(plain, _unit_before(plain, _back(plain, house.start(), _DIGITS))):
            yield m.span()


def _name_from(plain: str, at: int) -> int:
    """Where to look for a name that ends at a place from: 40 signs hold every ideographic one, four words every other."""
    low = max(0, at - 40)
    if not at or _IDEOGRAPH.match(plain[at - 1]):
        return low
    word = at
    for _ in range(4):
        word = plain.rfind(" ", 0, max(0, word))
    return min(low, word + 1)


def _names(plain: str, latin: bool) -> Iterator[tuple[int, int]]:
    for pattern in _CJK_NAMED + (_LATIN_NAMED if latin else []):
        for m in pattern.finditer(plain):
            if not _NOT_NAME.search(m["n"]) and not (m.start() and _INSIDE_WORD.match(plain, m.start() - 1) and plain[m.start()].isascii()):
                yield m.span("n")
    ends = [(_RECEIVES, _BEFORE_RECEIVES), (_TITLE_AFTER, _BEFORE_TITLE)] + ([(_SAYS, _BEFORE_SAYS)] if latin else [])
    for after, before in ends:
        for m in after.finditer(plain):
            low = _name_from(plain, m.start())
            if (n := before.search(plain[low : m.start()])) and not _NOT_NAME.search(n["n"]):
                yield low + n.start("n"), low + n.end("n")


def _said_again(plain: str, names: set[str]) -> Iterator[tuple[int, int]]:
    """Where names that a text introduces stand again in it: the same signs, and no part of a longer word or name."""
    for name in names:
        if len(name) < 3:
            continue
        outside = f"{CJK}·" if _IDEOGRAPH.match(name[0]) and "·" in name else "" if _IDEOGRAPH.match(name[0]) else r"\w-"
        at = plain.find(name)
        while at >= 0:
            end = at + len(name)
            if not outside or not re.match(f"[{outside}]", plain[at - 1 : at]) and not re.match(f"[{outside}]", plain[end : end + 1]):
                yield at, end
            at = plain.find(name, end)


def _find(plain: str) -> Iterator[tuple[int, int, int, str]]:
    """Finds as rank, from, to and kind."""
    latin = _CAPITAL.search(plain) is not None
    yield from ((0, *x, "email") for x in _emails(plain))
    yield from ((1 + (k == "phone"), a, b, k) for a, b, k in _numbers(plain))
    yield from ((3, *x, "address") for x in _addresses(plain, latin))
    named = list(_names(plain, latin))
    yield from ((4, *x, "name") for x in named)
    yield from ((6, *x, "name") for x in _said_again(plain, {plain[a:b] for a, b in named}))
    if "·" in plain:
        yield from ((5, *m.span(), "name") for m in _DOTTED.finditer(plain))


def find_items(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the items of a text in source code points, sorted; none overlap. Null has none.

    Of overlapping finds the earlier kind of email, id_number, phone, address, name counts, and of one kind the
    longest.
    """
    if not text:
        return []
    plain = Plain(text)
    taken: list[tuple[int, int, str]] = []  # by position; none overlap
    for _, a, b, kind in sorted(set(_find(plain.text)), key=lambda x: (x[0], x[1] - x[2], x[1])):
        i = bisect_right(taken, (a, b, kind))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b, kind))
    return sorted((kind, *plain.span(a, b)) for a, b, kind in taken)


def redact_text(text: str | None) -> str | None:
    """The text with a typed placeholder in place of each item, all else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(find_items(text), key=lambda x: x[1]):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def personal_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start_pos, end_pos): one row per item, positions in code points from 0, the end exclusive.

    Whole texts, one pass, no shuffle. Null and empty texts have no items; repeated rows give repeated items.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *i) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in find_items(t)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [b.schema.field(0).type, pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "kind", "start_pos", "end_pos"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, kind string, start_pos long, end_pos long").withColumnRenamed("key", key)


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): every text with placeholders; null stays null and empty stays empty."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b.iloc[:, 0], "text": b.iloc[:, 1].map(redact_text, na_action="ignore")})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"key {kind}, text string").withColumnRenamed("key", key)
