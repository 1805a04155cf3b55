"""Variant spellings of names typed by people (problem 4).

Every distinct string is a profile. Schools and majors begin with the registry's official names and nothing else; a string matches
a spelling it abbreviates (some of its characters in order, or a part), puts in another order, translates word by word or misspells by a
character, and the initials of a spelling in words. What matches lends its spelling and initials to the profile, and the richer profiles
re-enter blocking and meet the strings still open, round by round, until no further merge occurs. Authors are blocked by the Latin reading of their names; inside a
block profiles merge when they share a written name or a school, the union of their spellings and schools meets the rest
again, until nothing merges.

Defined results: null, blank and placeholder names take no part; a string that fits several entities equally well stays
alone; strings equal after normalisation merge whether or not the registry knows them; repeated rows count once; an
empty registry leaves schools and majors to normalised equality; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.splits import names_nobody
from scriptorium.runtime import cut

#: Traditional forms in names of schools and majors, and their simplified ones.
TRADITIONAL = str.maketrans("學碩會計遊營銷場務經濟業與術財務項統係師範農漢華圖書館電腦網絡機構廣東蘇灣臺貿語習教導護醫藥鐵鋼礦", "学硕会计游营销场务经济业与术财务项统系师范农汉华图书馆电脑网络机构广东苏湾台贸语习教导护医药铁钢矿")
#: Characters taken for one another by shape or sound.
ALIKE = "沧苍仓 穹穷 暮幕墓慕 岭领 澜斓谰兰 岚蓝兰 梧吾悟 潮朝 溪奚 山汕 墟虚 泊柏 绛降 朔溯 泠冷玲 屿与 岬胛 澄澂 埠阜 理里 商尚 经金 范犯 林淋 通同 大太 硕顾 管菅 计记 场埸 资姿 流硫 系糸 目日 术木 融溶 共供 及与"
#: Latin readings of the characters in place names.
PLACES = dict(zip("澄湖云埠临澜北屿青岬沧原岚川栖梧望潮远溪霁山玄岭暮锦丹墟枫泊绛河穹朔洲泠州", "cheng hu yun bu lin lan bei yu qing jia cang yuan lan chuan qi wu wang chao yuan xi ji shan xuan ling mu jin dan xu feng bo jiang he qiong shuo zhou leng zhou".split()))
#: What words in names of schools and majors mean, as ideographs; titles of degrees stand for the names they abbreviate.
GLOSSARY = {
    k: v.split("/")
    for k, v in (
        x.split("=")
        for x in (
            "university=大学 univ=大学 institute=学院 inst=学院 college=学院 school=学院 finance=财/金融 economics=经济/经/济 economic=经济 science=理/科学 technology=技术/工 technical=技术 business=商/工商 normal=师范 "
            "agriculture=农 agricultural=农 forestry=林 jiaotong=交通 management=管理 administration=管理 accounting=会计 accountancy=会计 marketing=市场营销/营销 human=人力/人 resource=资源 resources=资源 "
            "project=项目 tourism=旅游 logistics=物流 engineering=工程 public=公共 information=信息 system=系统 systems=系统 executive=高级管理人员/高级 master=硕士 science=理 "
            "mba=工商管理硕士 emba=高级管理人员工商管理硕士 mpa=公共管理 mta=旅游管理 mpacc=会计 mf=金融 mis=信息管理/信息系统"
        ).split()
    )
}
#: Words that mean nothing by themselves.
EMPTY_WORDS = frozenset("of and in for the a an on".split())


def alike() -> set[tuple[str, str]]:
    return {(a, b) for g in ALIKE.split() for a in g for b in g if a != b}


def folded(s: str) -> str:
    """One width, case, script and no spaces."""
    return re.sub(r"[\s·•・]+", "", unicodedata.normalize("NFKC", s)).lower().translate(TRADITIONAL)


def _near(a: str, b: str, pairs: set[tuple[str, str]]) -> float:
    """0 for equal strings, 0.5 for one character taken for one like it, 1 for one other character, 9 beyond."""
    if a == b:
        return 0.0
    if len(a) != len(b):
        return 9.0
    d = [(x, y) for x, y in zip(a, b) if x != y]
    if len(d) != 1:
        return 9.0
    return 0.5 if d[0] in pairs else 1.0


HAN = re.compile("[㐀-鿿]+")
LATIN_WORDS = re.compile(r"[a-z]+")


def is_latin(s: str) -> bool:
    return sum(c.isascii() and c.isalpha() for c in s) > 0.6 * len(re.sub(r"\W", "", s) or "x")


def latin_words(s: str) -> str:
    """Words of a name in the Latin alphabet, in order, abbreviations with dots in one."""
    t = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m.group().replace(".", ""), unicodedata.normalize("NFKC", s).lower())
    return " ".join(w for w in LATIN_WORDS.findall(t) if w not in EMPTY_WORDS)


def school_core(s: str) -> str:
    """A school's name without its departments."""
    raw = unicodedata.normalize("NFKC", s).strip()
    if is_latin(raw):
        return latin_words(raw)
    t = folded(raw)
    m = re.fullmatch(r"(.+?)\((.+?)\)", t)
    if m:
        head, inner = m.groups()
        # a place put behind, or a department
        t = inner + head if len(inner) <= 3 and not re.search("中心|学院|系|部|[a-z]", inner) and (len(head) > len(inner) or head in ("大学", "学院")) else head
    i = min((j for j in (t.find("大学"), t.find("学院")) if j > 0), default=-1)
    return t[: i + 2] if i > 0 else t


def major_core(s: str) -> str:
    return latin_words(s) if is_latin(s) else re.sub(r"[()]", "", folded(s))


def reading(name: str) -> str:
    """How a name begins when its place is written in Latin letters: the readings of its characters as far as they are known."""
    out = ""
    for c in name:
        if c not in PLACES:
            break
        out += PLACES[c]
    return out


def meaning(words: list[str], official: str) -> float | None:
    """The share of an official name that words in the Latin alphabet stand for; none if one of them stands for nothing in it. A place may be misspelt a little, for a tenth each."""
    place = reading(official)
    hit = [False] * len(official)
    wrong = 0
    n_place = next((i for i, c in enumerate(official) if c not in PLACES), len(official)) if place else 0
    for w in words:
        found = False
        for t in GLOSSARY.get(w, ()):
            i = official.find(t)
            if i >= 0:
                found = True
                hit[i : i + len(t)] = [True] * len(t)
                break
        if not found and place and (e := _edits(w, place)) <= (1 if len(place) < 7 else 2):
            found = True
            wrong += e
            hit[:n_place] = [True] * n_place
        if not found:
            return None
    if place and not hit[0]:
        return None
    return sum(hit) / len(hit) - 0.1 * wrong


def abbreviates(a: str, b: str) -> bool:
    """The characters of a are some of b's, in order, from the first on."""
    it = iter(b)
    return a[0] == b[0] and all(c in it for c in a)


def keys(f: str, lent: bool) -> list[str]:
    """Where spellings near this one are found; those a profile has are found by more keys than the string that looks for one."""
    if not HAN.search(f):
        return [f"w:{w}" for w in f.split()] + [f"i:{''.join(w[0] for w in f.split())}" if " " in f else f"i:{f}"]
    out = [f"b:{f[i : i + 2]}" for i in range(len(f) - 1)] + [f"m:{''.join(sorted(f))}"]
    # abbreviations share the first character and some later one
    out += [f"a:{f[0]}{c}" for c in dict.fromkeys(f[1:] if lent else f[1:2])]
    # a short string with a wrong character may share no two neighbours
    out += [f"e:{f[:i]}?{f[i + 1 :]}" for i in range(len(f))] if 3 <= len(f) <= 6 else []
    han = "".join(HAN.findall(f))
    if han != f and len(han) >= 2 and not lent:
        out.append(f"a:{han[:2]}")
    if lent:
        out += [f"w:{w}" for w, ts in GLOSSARY.items() if any(t in f for t in ts)] + ([f"w:{reading(f)}"] if reading(f) else [])
    return out


def distance(core: str, f: str, pairs: set[tuple[str, str]]) -> float:
    """Of a string from a spelling: below 0 for the same, under 2 if they may mean the same."""
    if core == f:
        return -1.0
    latin = not HAN.search(core)
    if not HAN.search(f):
        # initials of a spelling in words, or a word or two misspelt
        if latin and " " in f and core == "".join(w[0] for w in f.split()):
            return 0.2
        return 0.8 if latin and len(core) > 6 and _edits(core, f) <= 1 else 9.0
    if latin:
        m = meaning(core.split(), f)
        return 1.2 - m if m is not None and m >= 0.5 else 9.0
    gap = 0.01 * abs(len(core) - len(f))
    if len(core) >= 3 and sorted(core) == sorted(f):
        return 0.2
    han = "".join(HAN.findall(core))
    if 2 <= len(core) < len(f) and abbreviates(core, f):
        return 0.3 + gap
    if han != core and 2 <= len(han) < len(f) and abbreviates(han, f):
        return 0.35 + gap
    if len(core) >= 2 and core in f:
        return 0.4 + gap
    if len(f) >= 2 and f in core:
        return 0.5 + gap
    d = _near(core, f, pairs) if len(f) >= 4 or (len(f) == len(core) == 3) else 9.0
    return 0.25 if d == 0.5 else d


def _edits(a: str, b: str) -> int:
    if abs(len(a) - len(b)) > 2:
        return 9
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


#: A key of more spellings than this share of the registry tells nothing apart: it is none.
COMMON_KEY = 0.2


def _keyed(df: DataFrame, schema: str, lent: bool, common: list[str]) -> DataFrame:
    """Rows once for each block key of their column core, and once for the string itself."""
    drop = frozenset(common)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(key=[list(dict.fromkeys([f"={c}", *(k for k in keys(c, lent) if k not in drop)])) for c in pdf["core"]]).explode("key")

    return df.mapInPandas(run, f"{schema}, key string")


def _matched(cores: DataFrame, forms: DataFrame, common: list[str]) -> DataFrame:
    """(core, e, d): the entity each string is nearest to, if it is one, and how near; forms has e and core, the spellings of entities."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = alike()
        for pdf in it:
            pdf = pdf.assign(d=[round(distance(c, f, pairs), 3) for c, f in zip(pdf["core"], pdf["form"])])
            yield pdf.loc[pdf["d"] < 2.0, ["core", "e", "d"]]

    at = _keyed(forms.select("e", "core"), "e bigint, core string", True, common).withColumnRenamed("core", "form")
    near = _keyed(cores.select("core"), "core string", False, common).join(at, "key").select("core", "e", "form").mapInPandas(run, "core string, e bigint, d double")
    best = near.groupBy("core", "e").agg(F.min("d").alias("d")).groupBy("core", "d").agg(F.count("*").alias("n"), F.min("e").alias("e"))
    return best.groupBy("core").agg(F.min(F.struct("d", "n", "e")).alias("b")).where("b.n = 1").select("core", "b.e", "b.d")


def resolve_registered(values: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
    """(name, entity): the profile of each distinct string (column name), an entity of the registry or the string's own normal form.

    Spellings of entities are a table, to which every string that matched adds its own, until a round adds none.
    """
    spark = values.sparkSession
    official = {r["entity_id"]: r["official_name"] for r in registry.where(F.col("kind") == kind).collect()}  # a fixed table
    names_of = school_core if kind == "school" else major_core
    first = [(e, names_of(o)) for e, o in official.items() if o and names_of(o)]
    often = Counter(k for _, f in first for k in set(keys(f, True)) if k[:2] in ("b:", "a:"))
    common = [k for k, n in often.items() if n > max(3, COMMON_KEY * len(first))]
    core = school_core if kind == "school" else major_core

    def cored(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"name": pdf["name"], "core": [core(n) for n in pdf["name"]]})

    names = cut(values.where(~names_nobody(F.col("name"))).select("name").distinct().mapInPandas(cored, "name string, core string"), "cores")
    forms = spark.createDataFrame(first, "e bigint, core string")
    left = names.select("core").distinct()
    done = spark.createDataFrame([], "core string, e bigint")
    while official:
        new = cut(_matched(left, forms, common), "matched")
        done = done.unionByName(new.select("core", "e"))
        lent = new.where("d >= 0").select("e", "core")
        if lent.isEmpty():
            break
        forms = forms.unionByName(lent)
        left = cut(left.join(new, "core", "left_anti"), "left")
    return names.join(done, "core", "left").select("name", F.coalesce(F.concat(F.lit(f"{kind}:"), F.col("e").cast("string")), F.concat(F.lit("own:"), F.col("core"))).alias("entity"))


def author_core(s: str) -> str | None:
    """The name in ideographs, without spaces, dots, remarks and nicknames."""
    t = re.sub(r"[\s·•・.]+", "", unicodedata.normalize("NFKC", s))
    outside = "".join(HAN.findall(re.sub(r"[(\[].*?[)\]]", "", t)))
    if len(outside) >= 2:
        return outside
    inside = HAN.findall(t)
    return max(inside, key=len) if inside and len(max(inside, key=len)) >= 2 else None


def author_key(s: str, readings: dict[str, str]) -> tuple[str | None, str]:
    """The name in ideographs, if there is one, and the block: surname and given name in Latin letters, in either order."""
    c = author_core(s)
    if c:
        r = [readings.get(x, x) for x in c]
        return c, "|".join(sorted([r[0], "".join(r[1:])]))
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).replace("ü", "yu").replace("-", "").replace("'", ""))
    t = re.sub(r"\(.*?\)", " ", "".join(x for x in t if not unicodedata.combining(x)))
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]{2,}(?![a-z])|[A-Z]", t)]
    if len(words) > 2:
        # a given name in two parts
        words = [words[0], "".join(words[1:])] if "," in t or len(words[0]) <= len(words[-1]) else ["".join(words[:-1]), words[-1]]
    return None, "|".join(sorted(words)) if words else folded(s)


def merge_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Profiles of one reading: merged by a shared written name or school, then those without a school by what is left to choose from."""
    n = len(pdf)
    cores = [{c} if isinstance(c, str) and c else set() for c in pdf["core"]]
    schools = [set(x) if x is not None else set() for x in pdf["schools"]]
    majors = [set(x) if x is not None else set() for x in pdf["majors"]]
    groups = [{"i": {i}, "c": cores[i], "s": schools[i], "m": majors[i]} for i in range(n)]
    while True:
        merged: list[dict] = []
        at: dict[tuple, dict] = {}
        changed = False
        for g in groups:
            hits = []
            for k in [("c", x) for x in g["c"]] + [("s", x) for x in g["s"]]:
                h = at.get(k)
                if h is not None and all(h is not y for y in hits):
                    hits.append(h)
            if hits:
                changed = True
                into = hits[0]
                for h in [*hits[1:], g]:
                    for f in "icsm":
                        into[f] |= h[f]
                merged = [x for x in merged if all(x is not h for h in hits[1:])]
            else:
                into = {f: set(v) for f, v in g.items()}
                merged.append(into)
            for k in [("c", x) for x in into["c"]] + [("s", x) for x in into["s"]]:
                at[k] = into
        groups = merged
        if not changed:
            loose = [g for g in groups if not g["s"]]
            for g in loose:
                others = [x for x in groups if x is not g]
                fit = others if len(others) == 1 else [x for x in others if x["m"] & g["m"]]
                if len(fit) == 1:
                    for f in "icsm":
                        fit[0][f] |= g[f]
                    groups = [x for x in groups if x is not g]
                    changed = True
                    break
            if not changed:
                break
    names = list(pdf["name"])
    out = [(names[i], min(names[j] for j in g["i"])) for g in groups for i in g["i"]]
    return pd.DataFrame(out, columns=["name", "entity"])


def resolve_authors(people: DataFrame, readings: DataFrame) -> DataFrame:
    """(name, entity) of authors: people has name, school and major entity of every record."""
    spark = people.sparkSession
    table = spark.sparkContext.broadcast({r["ch"]: r["reading"] for r in readings.where("ch IS NOT NULL AND reading IS NOT NULL").collect()})  # a fixed table of characters
    prof = people.where(~names_nobody(F.col("name"))).groupBy("name").agg(F.collect_set("school").alias("schools"), F.collect_set("major").alias("majors"))

    def keyed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ks = [author_key(x, table.value) for x in pdf["name"]]
            yield pd.DataFrame({"name": pdf["name"], "core": [k[0] for k in ks], "key": [k[1] for k in ks], "schools": pdf["schools"], "majors": pdf["majors"]})

    blocks = prof.mapInPandas(keyed, "name string, core string, key string, schools array<string>, majors array<string>")
    # a block holds the ways to write one reading, most of them a single one; only the others are worked on
    rows = blocks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("name", "core", "schools", "majors"))).alias("b"))

    def merged(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [merge_block(pd.DataFrame(list(b))) for b in pdf["b"]]
            if out:
                yield pd.concat(out)

    alone = rows.where(F.size("b") == 1).select(F.col("b")[0]["name"].alias("name"), F.col("b")[0]["name"].alias("entity"))
    return rows.where(F.size("b") > 1).select("b").mapInPandas(merged, "name string, entity string").unionByName(alone)


def linked(metadata: DataFrame, registry: DataFrame, readings: DataFrame) -> DataFrame:
    """(field, name, entity) of every distinct usable string of the three columns."""
    m = metadata.select("school", "major", "author")
    s = cut(resolve_registered(m.select(F.col("school").alias("name")), registry, "school"), "schools")
    j = cut(resolve_registered(m.select(F.col("major").alias("name")), registry, "major"), "majors")
    people = (
        m.select(F.col("author").alias("name"), "school", "major").distinct()
        .join(s.select(F.col("name").alias("school"), F.col("entity").alias("se")), "school", "left")
        .join(j.select(F.col("name").alias("major"), F.col("entity").alias("me")), "major", "left")
        .select("name", F.col("se").alias("school"), F.col("me").alias("major"))
    )
    a = resolve_authors(people, readings)
    tag = lambda df, f: df.select(F.lit(f).alias("field"), "name", "entity")
    return tag(s, "school").unionByName(tag(j, "major")).unionByName(tag(a, "author"))


def found(metadata: DataFrame, registry: DataFrame, readings: DataFrame) -> DataFrame:
    """(field, name_a, name_b): all pairs of spellings of one entity; an entity has as many strings as people found ways to write it."""
    x = cut(linked(metadata, registry, readings), "linked")
    a, b = x.select("field", "entity", F.col("name").alias("name_a")), x.select("field", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["field", "entity"]).where("name_a < name_b").select("field", "name_a", "name_b").distinct()
