"""Variant spellings of persons' and organisations' names to groups (problem 6).

Names in their plain form are read into a kind, a full key (given name and surname; place, number and kind of body)
and, where they leave something out, what is left. Equal keys tie names together; keys of one kind within edit
distance 1 are found by the metric-space radius join; aliases tie a name to its record's other names. A name with only
an initial, a nickname of several meanings, a surname or no county sign follows if just one candidate remains.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import connected_components
from factloom.llm.glyphs import plain_column
from factloom.llm.metric import _within, radius_join
from factloom.session import cut, shuffle_width

# Common short forms of English given names.
NICKNAMES = {
    "Adelaide": "Addie Addy Della", "Alexander": "Alex Sasha Sandy Alec Xander", "Alexandra": "Sasha Alex Sandra", "Andrew": "Andy Drew",
    "Anthony": "Tony", "Augustin": "Gus Augie", "Augustus": "Gus", "Bartholomew": "Bart Tolly Barty Bat", "Benjamin": "Ben Benny",
    "Caroline": "Carrie Lina", "Catherine": "Cathy Kate Kitty Katie Cat", "Charles": "Charlie Chuck", "Christopher": "Chris Kit", "Constantin": "Kostya Costa Stan",
    "Daniel": "Dan Danny", "David": "Dave Davy", "Dorothea": "Dolly Dora Dot Dottie Thea", "Dorothy": "Dolly Dora Dot Dottie", "Edmund": "Ned Ed",
    "Edward": "Ted Ned Ed Eddie Teddy", "Eleanor": "Nora Nell Ellie Nellie Lena", "Elizabeth": "Liz Betty Beth Bess Eliza Lizzie Betsy Lisa", "Frances": "Fanny Frankie",
    "Francis": "Frank", "Frederick": "Fred Freddy Freddie Fritz", "Gabriel": "Gabe", "George": "Georgie", "Gregory": "Greg", "Harold": "Hal Harry",
    "Helen": "Nell Nellie", "Henry": "Harry Hank Hal", "Isabella": "Bella Izzy", "James": "Jim Jimmy Jamie", "John": "Jack Johnny", "Jonathan": "Jon",
    "Joseph": "Joe Joey", "Josephine": "Josie Jo Fina Posy", "Katherine": "Kitty Kate Kathy Katie Kit Kay", "Lawrence": "Larry", "Leonard": "Leo Len Lenny",
    "Louis": "Lou", "Margaret": "Maggie Peggy Meg Madge Rita Greta Daisy", "Martha": "Patty", "Martin": "Marty", "Mary": "Molly Polly", "Matthew": "Matt", "Michael": "Mike Mick",
    "Nicholas": "Nick Klaus Nicky Cole", "Patrick": "Pat Paddy", "Peter": "Pete", "Philip": "Phil Pip", "Philippa": "Pippa Pip", "Rebecca": "Becky", "Richard": "Dick Rick Rich Ricky",
    "Robert": "Bob Rob Bobby Bert Robin", "Samuel": "Sam", "Sarah": "Sally Sadie", "Stephen": "Steve", "Susannah": "Sukey Sue Susie Susan", "Theodora": "Thea Dora Theo", "Theodore": "Theo Teddy Ted",
    "Thomas": "Tom Tommy", "Timothy": "Tim", "Victoria": "Vicky", "Walter": "Walt Wally", "Wilhelmina": "Mina Willa Minnie Billie Wilma", "William": "Will Bill Billy Willie Liam",
}
ORDINAL_WORDS = "First Second Third Fourth Fifth Sixth Seventh Eighth Ninth Tenth Eleventh Twelfth"
LATIN_TITLES = "Comrade Mr Mrs Miss Ms Dr Prof Professor Sir Madam Captain Colonel General"
CJK_TITLES_AFTER = "先生 女士 同志 小姐 夫人 老师 教授 师傅"
CJK_TITLES_BEFORE = "老 小"
CJK_PET_BEFORE, CJK_PET_AFTER = "老小阿", "儿"
PLACE_SIGNS = "市县旗镇乡区省村"
CJK_DIGITS = "零一二三四五六七八九"

CJK = "〇㐀-䶿一-鿿"
NUMERAL = r"(?:[一二三四五六七八九十]{1,3}|\d{1,3})"
ORDINALS = {w.lower(): i + 1 for i, w in enumerate(ORDINAL_WORDS.split())}
NTH = rf"(?:{'|'.join(ORDINAL_WORDS.split())}|\d+(?:st|nd|rd|th))"
ORG_CJK = [
    re.compile(rf"^(?P<place>[{CJK}]{{2,}}?)第(?P<num>{NUMERAL})(?P<kind>[{CJK}]{{2,}})$"),
    re.compile(rf"^第(?P<num>{NUMERAL})(?P<kind>[{CJK}]{{2,}})\((?P<place>[{CJK}]{{2,}})\)$"),
    re.compile(rf"^(?P<place>[{CJK}]{{2,}}?[{PLACE_SIGNS}])(?P<kind>[{CJK}]{{2,}})第(?P<num>{NUMERAL})部$"),
    re.compile(rf"^(?P<place>[{CJK}]{{3,6}})(?P<num>[一二三四五六七八九十]|\d)(?P<kind>[{CJK}]{{2,}})$"),
]
COUNTY = r"(?: County| Co\.)?"
ORG_LATIN = [
    re.compile(rf"^(?P<place>.+?){COUNTY} (?P<num>{NTH}) (?P<kind>[A-Z].+)$"),
    re.compile(rf"^(?P<num>{NTH}) (?P<kind>.+?) of (?P<place>.+?){COUNTY}$"),
    re.compile(rf"^(?P<kind>[^,]+), (?P<place>.+?){COUNTY} \((?P<num>{NTH})\)$"),
]
WORD = re.compile(r"^[^\W\d_][\w'’.-]*$")


def _number(text: str) -> str:
    if text.lower() in ORDINALS:
        return str(ORDINALS[text.lower()])
    if digits := re.sub(r"\D", "", text):
        return str(int(digits))
    tens, ten, ones = text.rpartition("十")
    value = (CJK_DIGITS.index(tens) if tens else 1) * 10 if ten else 0
    return str(value + (CJK_DIGITS.index(ones) if ones else 0))


def read_body(name: str) -> dict | None:
    """Place, place sign, number and kind of an organisation's name, or None."""
    for latin, patterns in ((False, ORG_CJK), (True, ORG_LATIN)):
        for p in patterns:
            if m := p.match(name):
                place, sign = m["place"], ""
                if not latin and len(place) > 2 and place[-1] in PLACE_SIGNS:
                    place, sign = place[:-1], place[-1]
                return {"script": "latin" if latin else "cjk", "place": place.lower(), "sign": sign, "num": _number(m["num"]), "kind": m["kind"]}
    return None


class GivenNames:
    """Given names that occur in the data or the table of short forms, and what a written form may stand for."""

    def __init__(self, learned: Iterable[str]) -> None:
        self.formal = {x.lower() for x in [*learned, *NICKNAMES]}
        self.short = defaultdict(set)
        for formal, nicks in NICKNAMES.items():
            for n in nicks.split():
                self.short[n.lower()].add(formal.lower())
        self.formal -= set(self.short)
        self.near, self.longest = defaultdict(set), max(map(len, self.formal), default=0)
        for f in self.formal:
            for i in range(len(f)):
                self.near[f[:i] + f[i + 1 :]].add(f)
            self.near[f].add(f)

    def known(self, word: str) -> bool:
        return word in self.formal or word in self.short

    def close(self, word: str) -> bool:
        if not 3 < len(word) <= self.longest + 1:
            return False
        cuts = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
        return any(_within(word, f, 1) for c in cuts for f in self.near.get(c, ()))


def read_person(name: str, given_names: GivenNames) -> dict | None:
    """block (surname), given (a full given name) or starts (what the given name may be), of a person's name, or None."""
    if re.search(rf"[{CJK}]", name):
        return _read_cjk(name)
    comma = re.match(r"^([^,]+), ([^,]+)$", name)
    words = (comma[2] + " " + comma[1] if comma else name).split(" ")
    titled = len(words) > 1 and words[0].rstrip(".") in LATIN_TITLES.split()
    words = words[1:] if titled else words
    if not all(WORD.match(w) for w in words) or (len(words) == 1 and not titled):
        return None
    low = [w.lower() for w in words]
    if len(words) == 1:
        return {"script": "latin", "block": low[0], "starts": [""]}
    sure = lambda w: given_names.known(w) or bool(re.fullmatch(r"\w\.", w))
    first_is_surname = not comma and len(words[0]) > 2 and (words[0].isupper() and not words[1].isupper() or sure(low[-1]) and not sure(low[0]) and not given_names.close(low[0]))
    given, surname = (low[1], low[0]) if first_is_surname else (low[0], low[-1])
    if re.fullmatch(r"\w\.", given):
        return {"script": "latin", "block": surname, "starts": [given[0]]}
    if given in given_names.short and given not in given_names.formal:
        return {"script": "latin", "block": surname, "starts": sorted(given_names.short[given])}
    if given in given_names.formal or given_names.close(given):
        return {"script": "latin", "block": surname, "given": given}
    return None


def _read_cjk(name: str) -> dict | None:
    bare, titled = name, False
    for t in CJK_TITLES_AFTER.split():
        if bare.endswith(t) and len(bare) > len(t) + 1:
            bare, titled = bare[: -len(t)], True
            break
    if m := re.fullmatch(f"([{CJK}]+)老\\(([{CJK}]+)\\)", bare):
        return {"script": "cjk", "joined": m[1] + m[2], "block": None, "starts": None}
    parts = bare.split("·")
    if not titled and len(parts) == 1 and bare[:1] in CJK_TITLES_BEFORE.split() and len(bare) >= 4:
        bare, titled = bare[1:], True
        parts = [bare]
    if not all(re.fullmatch(f"[{CJK}]+", p) for p in parts) or len(bare) < 2:
        return None
    if len(parts) == 1:
        return {"script": "cjk", "joined": bare, "block": bare if titled else None, "starts": [""] if titled else None}
    given, surname = (parts[0], parts[-1]) if len(parts[0]) <= len(parts[-1]) else (parts[-1], parts[0])
    if len(given) == 1:
        return {"script": "cjk", "block": surname, "starts": [given]}
    return {"script": "cjk", "block": surname, "given": given}


def pet_of(joined: str) -> str | None:
    """Whom an undotted pet form names, as pet_keys has it: 小杨野 keeps surname and last sign, 吴砚青儿 the whole name."""
    if len(joined) == 3 and joined[0] in CJK_PET_BEFORE:
        return f"{joined[1]}*{joined[2]}"
    return "=" + joined[:-1] if len(joined) > 3 and joined.endswith(CJK_PET_AFTER) else None


def plain_keys(name: str) -> list[str]:
    """A name that no reader reads, as written without case and comma, and its words in order, for the radius join."""
    comma = re.match(r"^([^,]+), ([^,]+)$", name)
    words = (comma[2] + " " + comma[1] if comma else name).lower().split(" ")
    return sorted({" ".join(words), " ".join(sorted(words))})


def match_kind(kind: str, kinds: list[str]) -> str | None:
    """The one known kind of body that a written kind means: the same, one typing error away, or abbreviated."""
    if kind in kinds:
        return kind
    near = [k for k in kinds if _within(kind.lower(), k.lower(), 1)]
    if not near:
        near = [k for k in kinds if _abbreviates(kind, k)]
    return near[0] if len(near) == 1 else None


def _inside(short: str, whole: str) -> bool:
    rest = iter(whole)
    return all(c in rest for c in short)


def _abbreviates(short: str, whole: str) -> bool:
    if " " not in whole and " " not in short:
        return 2 <= len(short) < len(whole) and _inside(short, whole)
    a, b = short.lower().replace(".", "").split(), whole.lower().split()
    return len(a) == len(b) and all(x[:1] == y[:1] and _inside(x, y) for x, y in zip(a, b, strict=True))


def settle_kinds(counts: dict[str, int]) -> list[str]:
    """The kinds that stand for themselves: those that aren't a shortening or misspelling of a kind three times as common."""
    out: list[str] = []
    for kind in sorted(counts, key=lambda k: (-counts[k], k)):
        common = [k for k in out if counts[k] >= 3 * counts[kind]]
        if not any(_within(kind.lower(), k.lower(), 1) or _abbreviates(kind, k) for k in common):
            out.append(kind)
    return out


READ = "form string, role string, kind string, block string, key string, starts array<string>, joined array<string>, person boolean, named boolean"
NUMERALS = r"[^0-9零〇一二三四五六七八九十]+"


def _reader(given: GivenNames, kinds: dict[str, list[str]]):
    known: dict[tuple[str, str], str | None] = {}

    def kind_of(body: dict) -> str | None:
        at = body["script"], body["kind"]
        if at not in known:
            if len(known) > 100_000:
                known.clear()
            known[at] = match_kind(at[1], kinds[at[0]])
        return known[at]

    def one(name: str, person: bool, body: bool) -> Iterator[tuple]:
        unread = name, "plain", "plain", "", None, None, plain_keys(name)
        if b := read_body(name):
            kind = kind_of(b) or (b["kind"] if body else None)
            if kind is None:
                yield unread
                return
            rest = f"{b['num']}|{kind}"
            if kind_of(b) is None:
                yield unread
            if b["script"] == "cjk" and not b["sign"]:
                yield name, "short", "body cjk", f"{b['place']}|{rest}", None, [""], None
            else:
                yield name, "full", f"body {b['script']}", f"{rest}|{b['sign']}", b["place"], None, None
            return
        read = read_person(name, given)
        if read is None:
            yield unread
            comma = re.match(r"^([^,]+), ([^,]+)$", name)
            words = (comma[2] + " " + comma[1] if comma else name).lower().split(" ")
            if person and len(words) >= 2 and all(WORD.match(w) for w in words):
                yield name, "full", "person latin", words[-1], f"{words[0]} {words[-1]}", None, None
            return
        kind, block, g = f"person {read['script']}", read.get("block"), read.get("given")
        if g:
            joined = [g + block, block + g] if read["script"] == "cjk" else None
            yield name, "full", kind, block, f"{g} {block}", None, joined
        else:
            yield name, "short", kind, block, None, read.get("starts"), [read["joined"]] if read.get("joined") else None

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r, p, p or o) for f, p, o in zip(b["form"], b["person"], b["body"], strict=True) for r in one(f, p, o)]
            yield pd.DataFrame(rows, columns=["form", "role", "kind", "block", "key", "starts", "joined", "person", "named"])

    return run


def _joined_hub(text) -> Column:
    return F.concat_ws("\x1f", F.lit("\x01joined"), text)


def _same_numerals(a: str, b: str) -> Column:
    """Whether two texts within one edit have the same numerals: an edited number names another body or year."""
    return F.regexp_replace(a, NUMERALS, " ") == F.regexp_replace(b, NUMERALS, " ")


def _joined_ends(joined: DataFrame) -> DataFrame:
    """(j, bare, sure) of names that stand joined, from j, role, named. Of two close ones that tie, one has to be without a
    dot and one to be a person's read name or to stand under a record of a person or body. Names of fewer than five signs
    are let out: there another sign is another person.
    """
    return joined.filter(F.length("j") >= 5).groupBy("j").agg(F.max(F.col("role") == "short").alias("bare"), F.max((F.col("role") == "full") | F.col("named")).alias("sure"))


def _close_joined(ends: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b) hubs of names without a dot that are one edit from another joined name."""
    end = lambda k: ends.select(F.col("j").alias(f"text_{k}"), F.col("bare").alias(f"bare_{k}"), F.col("sure").alias(f"sure_{k}"))
    met = near.join(end("a"), "text_a").join(end("b"), "text_b").filter("(bare_a or bare_b) and (sure_a or sure_b)").filter(_same_numerals("text_a", "text_b"))
    return met.select(_joined_hub("text_a").alias("a"), _joined_hub("text_b").alias("b"))


def _close_plain(keys: DataFrame, named: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b) of unread forms and hubs of their plain keys, where a record says person or body of one of the ends."""
    met = cut(near.filter(_same_numerals("text_a", "text_b")).select("text_a", "text_b"))
    told = named.filter("named").select("k").union(met.select("text_a")).union(met.select("text_b")).distinct()
    hub = lambda k: F.concat_ws("\x1f", F.lit("\x01plain"), k)
    return keys.join(told, "k").select(F.col("form").alias("a"), hub("k").alias("b")).unionByName(met.select(hub("text_a").alias("a"), hub("text_b").alias("b")))


def _pets(bare: DataFrame) -> DataFrame:
    """(a, b) of pet forms and the hub of the only recorded person they fit. bare: form, j, person, of names without a dot."""
    udf = F.pandas_udf(lambda names: names.map(pet_of), "string")
    pets = bare.withColumn("pet", udf("j"))
    whole = pets.filter(F.col("person") & (F.col("pet").isNull() | F.col("pet").startswith("="))).select("j").distinct()
    brief = F.when(F.length("j") == 3, F.concat(F.substring("j", 1, 1), F.lit("*"), F.substring("j", 3, 1)))
    of = whole.select("j", F.explode(F.array(F.concat(F.lit("="), "j"), brief)).alias("pet")).dropna()
    only = of.groupBy("pet").agg(F.min("j").alias("j"), F.max("j").alias("other")).filter("j = other")
    return pets.select("form", "pet").dropna().join(only, "pet").select(F.col("form").alias("a"), _joined_hub("j").alias("b"))


def _lexicon(forms: DataFrame) -> tuple[GivenNames, dict[str, list[str]]]:
    """Given names and kinds of bodies that occur with two or more partners, whatever the size of the data.

    A given name stands first with two or more surnames, and with more of them than it stands last with; known given
    names and initials are no surnames, so that a surname written first isn't taken for a given name.
    """
    built_in = GivenNames([])
    fixed = sorted(built_in.formal | set(built_in.short))
    low = F.lower("form")
    words = forms.filter(F.col("person") & F.col("form").rlike(r"^\p{Lu}[\p{L}'-]+( \p{Lu}[\p{L}'.-]*)?( \p{Lu}[\p{L}'.-]+)$"))
    ends = words.select(F.element_at(F.split(low, " "), 1).alias("first"), F.element_at(F.split(low, " "), -1).alias("last"))
    partner = lambda c: F.when(~F.col(c).isin(fixed) & ~F.col(c).rlike(r"^\p{L}\.$"), F.col(c))
    both = ends.select(F.col("first").alias("w"), partner("last").alias("surname"), F.lit(None).cast("string").alias("given")).unionByName(
        ends.select(F.col("last").alias("w"), F.lit(None).cast("string").alias("surname"), F.col("first").alias("given"))
    )
    firsts = both.groupBy("w").agg(F.countDistinct("surname").alias("n"), F.countDistinct("given").alias("after")).filter("n >= 2 and n > after")
    given = GivenNames(r["w"] for r in firsts.select("w").collect())

    def kind_of(names: pd.Series) -> pd.DataFrame:
        got = [read_body(n) for n in names]
        return pd.DataFrame([(f"{g['script']}|{g['kind']}", g["place"]) if g else (None, None) for g in got], columns=["kind", "place"])

    udf = F.pandas_udf(kind_of, "kind string, place string")
    bodies = forms.filter("body").select(udf("form").alias("k")).select("k.kind", "k.place").filter("kind is not null")
    counts: dict[str, dict[str, int]] = {"latin": {}, "cjk": {}}
    for r in bodies.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("place").alias("places")).filter("places >= 2").collect():
        script, _, kind = r["kind"].partition("|")
        counts[script][kind] = r["n"]
    return given, {s: settle_kinds(c) for s, c in counts.items()}


def name_groups(named: DataFrame, aliases: DataFrame) -> DataFrame:
    """(form, group) of all plain forms of persons' and organisations' names that are tied to some key or other form.

    named: form, person, body (whether records say so; both may be false). aliases: form, alias (both plain forms).
    Forms that read neither as a person nor as an organisation have a group only through an alias.
    """
    forms = cut(
        named.unionByName(aliases.select(F.col("alias").alias("form"), F.lit(False).alias("person"), F.lit(False).alias("body")))
        .groupBy("form").agg(F.max("person").alias("person"), F.max("body").alias("body"))
    )
    given, kinds = _lexicon(forms)
    spread = forms.select("form", "person", "body").repartition(shuffle_width(forms.sparkSession), "form")
    read = cut(spread.mapInPandas(_reader(given, kinds), READ))
    person = F.col("kind").startswith("person")  # of the read name, not of the record
    hub = lambda kind, block, key: F.concat_ws("\x1f", F.lit("\x01"), kind, block, key)
    full = read.filter("role = 'full'").select("form", "kind", "block", "key", "joined")
    own_hub = F.when(person, hub(F.col("kind"), F.lit(""), F.col("key"))).otherwise(hub(F.col("kind"), F.col("block"), F.col("key")))
    full = full.withColumn("hub", own_hub)
    by_joined = cut(read.filter(person & F.col("joined").isNotNull()).select("form", "role", "person", "named", F.explode("joined").alias("j")))
    ends = cut(_joined_ends(by_joined))
    keys = cut(read.filter("role = 'plain'").select("form", "named", F.explode("joined").alias("k")))
    named = cut(keys.groupBy("k").agg(F.max("named").alias("named")))
    texts = full.select("kind", F.when(person, F.lit("")).otherwise(F.col("block")).alias("block"), F.col("key").alias("text"), F.lit(True).alias("asks"))
    texts = texts.unionByName(ends.select(F.lit("joined").alias("kind"), F.lit("").alias("block"), F.col("j").alias("text"), F.col("sure").alias("asks")))
    texts = texts.unionByName(named.filter(F.length("k") >= 5).select(F.lit("plain").alias("kind"), F.lit("").alias("block"), F.col("k").alias("text"), F.col("named").alias("asks")))
    near = cut(radius_join(texts))
    read_hub = lambda text: hub(F.col("kind"), F.col("block"), F.col(text))
    close = near.filter("kind not in ('joined', 'plain')").select(read_hub("text_a").alias("a"), read_hub("text_b").alias("b"))
    whole = by_joined.select(F.col("form").alias("a"), _joined_hub("j").alias("b"))
    pets = _pets(by_joined.filter("role = 'short'"))
    bare = _close_joined(ends, near.filter("kind = 'joined'"))
    plain = _close_plain(keys, named, near.filter("kind = 'plain'"))
    sure = full.select(F.col("form").alias("a"), F.col("hub").alias("b")).unionByName(close).unionByName(whole).unionByName(bare).unionByName(pets).unionByName(plain)
    roots = cut(connected_components(sure))
    # what leaves something out follows the one candidate of its block that begins so
    rooted = full.join(roots.withColumnRenamed("vertex", "form"), "form")
    split = F.split("block", r"\|")
    begins = rooted.select(
        "kind", "root",
        F.when(person, F.col("block")).otherwise(F.concat_ws("|", "key", split[0], split[1])).alias("block"),
        F.explode(F.when(~person, F.array(F.lit(""))).otherwise(
            F.array(F.lit(""), F.substring("key", 1, 1), F.substring_index("key", " ", 1)))).alias("start"),
    )
    only = begins.groupBy("kind", "block", "start").agg(F.min("root").alias("root"), F.max("root").alias("other")).filter("root = other")
    short = read.filter("role = 'short' and block is not null").select("form", "kind", "block", F.explode("starts").alias("start"))
    follow = short.join(only.drop("other"), ["kind", "block", "start"]).groupBy("form").agg(F.min("root").alias("root"), F.max("root").alias("other")).filter("root = other")
    alike = short.filter("start <> '' or kind = 'body cjk'").select(F.col("form").alias("a"), hub(F.col("kind"), F.concat(F.lit("short"), F.col("block")), F.col("start")).alias("b"))
    one_start = short.filter("start <> ''").groupBy("form").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("form").alias("a"))
    alike = alike.join(one_start, "a", "left_semi").unionByName(alike.filter(F.col("b").contains("body cjk")))
    ties = (
        follow.select(F.col("form").alias("a"), F.col("root").alias("b"))
        .unionByName(alike)
        .unionByName(aliases.select(F.col("form").alias("a"), F.col("alias").alias("b")))
    )
    # what is tied already stands for its root, so that only the new ties between groups are left to follow
    root_of = lambda k: roots.select(F.col("vertex").alias(k), F.col("root").alias(f"{k}_root"))
    between = ties.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    between = between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b").distinct()
    merged = cut(connected_components(between))
    first = roots.join(merged.select(F.col("vertex").alias("root"), F.col("root").alias("group")), "root", "left").select("vertex", F.coalesce("group", "root").alias("group"))
    later = merged.join(roots.select("vertex"), "vertex", "left_anti").select("vertex", F.col("root").alias("group"))
    return first.unionByName(later).filter(~F.col("vertex").startswith("\x01")).withColumnRenamed("vertex", "form")


def record_forms(entities: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities (entity_id, form), mentions (mention, page_id, vote, form), and named and aliases for name_groups."""
    types = F.coalesce(F.col("semantic_entity_type"), F.col("source_entity_type"))
    rows = entities.filter(F.col("entity_id").isNotNull() & F.col("canonical_name").isNotNull()).select(
        "entity_id", "canonical_name", types.alias("type"),
        F.expr("try_variant_get(try_parse_json(aliases_json), '$', 'array<string>')").alias("aliases"),
    )
    own = cut(rows.withColumn("form", plain_column(F.col("canonical_name"))).select("entity_id", "form", "type", "aliases"))
    distinct_names = mentions.select("name").distinct()
    forms = cut(distinct_names.withColumn("form", plain_column(F.col("name"))))
    said = mentions.join(forms, "name").select("mention", "page_id", "vote", "form")
    listed = own.select("form", "type", F.explode("aliases").alias("alias")).filter("alias is not null").distinct()
    listed = listed.withColumn("alias", plain_column(F.col("alias"))).filter("alias <> form")
    agent = F.col("type").isin("Person", "Organization", "Other")
    named = own.select("form", (F.col("type") == "Person").alias("person"), (F.col("type") == "Organization").alias("body"))
    named = named.na.fill(False).unionByName(forms.select("form", F.lit(False).alias("person"), F.lit(False).alias("body")))
    aliases = cut(listed.filter(agent | F.col("type").isNull()).select("form", "alias"))
    return own.select("entity_id", "form").distinct(), said, named, aliases


def _in_groups(entities: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_id, form, group) and mentions (mention, form, group) that stand in a group."""
    own, said, named, aliases = record_forms(entities, mentions)
    groups = cut(name_groups(named, aliases))
    return cut(own.join(groups, "form")), said.join(groups, "form").select("mention", "form", "group")


def variant_groups(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(record_id, group_id, n_records, n_spellings): entities and mentions of groups with two visibly different names.

    One row per record, however large the group: nothing is paired. group_id is the group's smallest form.
    """
    own, heard = _in_groups(entities, mentions)
    rows = own.select(F.col("entity_id").alias("record_id"), "form", "group").unionByName(heard.select(F.col("mention").alias("record_id"), "form", "group"))
    by_form = rows.groupBy("group", "form").agg(F.count("*").alias("n"))
    sizes = by_form.groupBy("group").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_spellings"), F.min("form").alias("group_id")).filter("n_spellings > 1")
    return rows.join(sizes, "group").select("record_id", "group_id", "n_records", "n_spellings")


def variant_pairs(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id_a, id_b): entities of one person or organisation with visibly different names, and entities with mentions so."""
    in_group, said = _in_groups(entities, mentions)
    other = in_group.select("group", F.col("entity_id").alias("id_b"), F.col("form").alias("form_b"))
    pairs = in_group.join(other, "group").filter("entity_id < id_b and form <> form_b").select(F.col("entity_id").alias("id_a"), "id_b").distinct()
    heard = said.withColumnRenamed("form", "form_b")
    both = in_group.join(heard, "group").filter("form <> form_b").select(F.least("entity_id", "mention").alias("id_a"), F.greatest("entity_id", "mention").alias("id_b"))
    return pairs.unionByName(both.distinct())
