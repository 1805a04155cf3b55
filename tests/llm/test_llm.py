"""Operators for training text: hand-made cases, brute force, and defined results for odd input."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import encoding, language, lm, mixing, names, overlap, pairs, quality, scans, splits, tokens

ZH = "关于渠道结构能否间接影响投诉办结时间，前人研究尚存分歧。要想改善人均产值，家居卖场可以考虑推行项目复盘制度。本文采用因子分析，对保险代理机构的合规成本进行了考察。"
EN = "The results indicate that brand awareness explains much of the variation in market reach. It is therefore recommended that family restaurants unify the rating of suppliers. "


# splits ---------------------------------------------------------------------------------------------------------------
META = "doc_id string, paper_hash string, author string, school string, extra string"


def test_splits_ties(spark):
    m = spark.createDataFrame(
        [("d0000000001", "h1", "甲", "A", "x"), ("d0000000002", "h1", "乙", "B", None), ("d0000000003", None, "乙", "B", None), ("d0000000004", "e3b0c44298fc1c14", "未知", "B", None),
         ("d0000000005", "e3b0c44298fc1c14", "/", "B", None), ("d0000000006", "", " ", "B", None), (None, "h1", "甲", "A", None), ("d0000000003", None, "乙", "B", None)], META)
    v = spark.createDataFrame([("2016_d0000000002",), (" D0000000003 ",), ("2016/d0000000004/d0000000004.md",), ("d0000000002_17",), (None,), ("odd",)], "doc_id string")
    got = {tuple(r) for r in splits.found(m, v).collect()}
    one = "d0000000001"
    assert got == {("d0000000002", one), ("d0000000003", one), ("2016_d0000000002", one), (" D0000000003 ", one), ("d0000000002_17", one), ("2016/d0000000004/d0000000004.md", "d0000000004")}
    empty = splits.found(m.limit(0), v.limit(0))
    assert empty.count() == 0


def test_components_over_levels(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    for per_task in (10_000, 25):
        got = {x["v"]: x["root"] for x in splits.components(df, per_task).collect()}
        assert all(got[k] == find(k) for k in got) and len(got) == len({x for e in edges if e[0] != e[1] for x in e})


def test_greedy_shares():
    shares = {"train": 0.8, "dev": 0.1, "test": 0.1}
    out = splits.greedy_counts([(1, 5_000_000), (7, 1000), (400_000, 1)], shares)
    total = {k: 0 for k in shares}
    for s, runs in out.items():
        for k, n in runs:
            total[k] += s * n
    whole = sum(total.values())
    assert whole == 5_000_000 + 7000 + 400_000 and all(abs(total[k] / whole - shares[k]) < 0.001 for k in shares)
    assert out[400_000] == [("train", 1)]


def test_assign_keeps_groups(spark):
    m = spark.createDataFrame([(f"d{i:010d}", f"h{i // 3}", None, None, None) for i in range(300)], META)
    v = spark.createDataFrame([(f"d{i % 300:010d}",) for i in range(600)], "doc_id string")
    t = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split string, share double")
    a = splits.assign(m, v, t).cache()
    assert a.count() == 300 and a.groupBy("group_doc_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.03 for r in splits.report(a, t).collect())
    assert splits.assign(m.limit(0), v.limit(0), t).count() == 0


# scans ----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def decoder():
    r = random.Random(2)
    zh, en = ["关于", "渠道结构", "市场份额", "的", "以季度为单位，", "更加突出。", "三年间减少了", "系数约为", "利润率", "于霁山", "可以", "考虑", "改善", "企业", "成本", "管理者", "结果显示"], EN.split()
    texts = ["".join(r.choice(zh) for _ in range(60)) for _ in range(300)] + [" ".join(r.choice(en) for _ in range(60)) for _ in range(300)] + [ZH, EN] * 50
    q = np.zeros(lm.CELLS)
    for t in texts:
        a, _ = lm.joined([t])
        q += np.bincount(lm.pair_cells(a[:-1], a[1:]), minlength=lm.CELLS)
    import pyarrow as pa

    n = np.zeros(lm.CELLS)
    for b in scans._word_pairs(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])])):
        n[b.column(0).to_numpy()] += b.column(1).to_numpy()
    quant = lambda c: (np.where(c > 0, np.minimum(255, 1 + np.round(np.log(np.maximum(c, 1)) * lm.STEP)), 0).astype(np.uint8), float(c.sum()))
    return scans.Decoder(lm.PairModel(*quant(q)), lm.WordModel(*quant(n)))


def test_scan_noise(decoder):
    long_en = (EN * 2).strip()
    assert decoder.read(long_en)[0] == set()
    assert decoder.read(long_en.replace("awareness", "aware-\nness"))[0] == {"hyphenation"}
    kinds, fixed = decoder.read(long_en.replace("variation", "vcriation").replace("suppliers", "suppl1ers"))
    assert "misread" in kinds and "suppliers" in fixed
    assert decoder.read(long_en.replace("that family", "that\n- 17 -\nfamily"))[0] == {"page_number"}
    assert "running_header" in decoder.read(long_en.replace("that family", "that\nProfessional Degree Thesis\nfamily"))[0]
    assert decoder.read(long_en + " See page 12 of the appendix for the rating of suppliers.")[0] == set()


def test_scan_words_are_decoded_together(decoder):
    long_en = (EN * 2).strip()
    for bad, good in (("varia tion", "variation"), ("varia-\nti0n", "variation"), ("ofthe", "of the"), ("aw are ness", "awareness")):
        kinds, fixed = decoder.read(long_en.replace(good, bad, 1))
        assert kinds and fixed == long_en
    # Latin words in a Chinese text
    assert decoder.read(ZH + "即awarcness和suppl1ers。" + ZH)[1] == ZH + "即awareness和suppliers。" + ZH
    # each wrong character stands between right neighbours only once the other is undone
    zh = "关于渠道结构可以改善企业成本，管理者考虑市场份额。" * 2
    kinds, fixed = decoder.read(zh.replace("管理者", "菅埋者", 1))
    assert kinds == {"misread"} and fixed == zh


def test_scan_pairs_of_every_text(spark):
    """Neighbouring words count in Chinese texts, in texts with few letters e and with accents too; ideographs part them."""
    import pyarrow as pa

    def pairs_of(t):
        n = np.zeros(lm.CELLS)
        for b in scans._word_pairs(iter([pa.RecordBatch.from_arrays([pa.array([t])], names=["t"])])):
            n[b.column(0).to_numpy()] += b.column(1).to_numpy()
        return lambda w: n[lm.word_cells([w])[0]]

    zh = pairs_of(ZH + "采用Supply Chain模型，样本为30 firms与Cash，3.5。" + ZH)
    assert [zh(w) for w in ("supply chain", "0 firms", "chain 0", "firms cash", "cash 0")] == [1, 1, 0, 0, 1]
    assert pairs_of("Bu yıl şirkət satışı 12 faiz artdı.")("0 faiz") == 1
    assert [pairs_of("The naïve café here.")(w) for w in ("naïve café", "na ve")] == [1, 0]
    # two words run together whose pair occurs in Chinese texts only
    text = ZH + "企业应当改进Supply Chain，并重新评估。" + ZH
    rows = [(i, text) for i in range(2000)] + [(2000, text.replace("Supply Chain", "SupplyChain"))]
    got = scans.restore(spark.createDataFrame(rows, "row_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(2000, ["misread"], text)]


def test_scan_pages_inside_chinese_text(decoder):
    for page in ("-12-", "[3/40]"):
        assert decoder.read(ZH.replace("前人研究", page + "前人研究") + ZH) == ({"page_number"}, ZH + ZH)
    kept = ZH + "详见〔3〕。" + ZH
    assert decoder.read(kept) == (set(), kept)


def test_scan_paragraph_ends(decoder):
    # two paragraphs printed 20 characters a line: the first ends on a line of three fifths
    first, second = (ZH + ZH)[:-1][:131] + "。", ZH * 2
    wrap = lambda t: [t[i : i + 20] for i in range(0, len(t), 20)]
    lines = wrap(first) + wrap(second)
    assert 0.5 < len(wrap(first)[-1]) / 20 < 0.7
    assert decoder.paragraphs(lines, True) == first + "\n" + second
    # one sentence a line: the widths tell of no end
    assert "\n" not in decoder.paragraphs([x + "。" for x in (ZH * 2).split("。") if x], True)
    # and nothing like it inside a paragraph
    assert decoder.paragraphs(wrap(second), True) == second


def test_scan_table_forms(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "1\n2\n3"), (5, ZH), (5, ZH)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "row_id long, text string, noise int")
    assert scans.found(df).count() == 0
    assert scans.found(df.limit(0)).count() == 0


# overlap --------------------------------------------------------------------------------------------------------------
def long_text(seed, n=9):
    r = random.Random(seed)
    return "".join(f"{r.randint(1990, 2024)}年，{r.choice('甲乙丙丁戊己')}地区第{r.randint(1, 99999)}号{r.choice(['医院', '银行', '工厂', '门店'])}在{r.choice(['培训', '研发', '营销', '库存'])}方面的支出增长了{r.randint(1, 9999)}点。" for _ in range(n))


def test_overlap_hash():
    s = long_text(1)
    assert overlap.rolling(overlap.raw_codes(s), 20)[5] == overlap.passage_hash([s[5:25]])[0]


def test_overlap_pairs(spark):
    base = long_text(2)
    parts = [p + "。" for p in base.split("。") if p]
    near = "".join(reversed(parts))
    edited = base.replace("年", "岁", 1).replace("增长", "下降", 1)
    half = "".join(parts[:5]) + long_text(99, 4)
    cols = "row_id long, text string, split string, source string, h int"
    p = spark.createDataFrame(
        [(1, base, "train", "a", 1), (2, base, "dev", "a", 1), (3, near, "test", None, 1), (4, edited, "dev_hard", "b", 1), (5, half, "test", "b", 1), (6, base, None, "b", 1), (7, "短文本。", "train", "b", 1),
         (8, "短文本。", "dev", "b", 1), (9, None, "dev", "b", 1), (10, base, "train", "c", 1), (11, base.replace("，", " , "), "test_hard", "c", 1)], cols)
    v = spark.createDataFrame([(21, base, "train", None), (22, long_text(3), "dev", None)], "row_id long, variant_text string, split string, source string")
    got = {tuple(r) for r in overlap.found(p, v).collect()}
    want = {tuple(sorted((t, e))) for t in (1, 10, 21) for e in (2, 3, 4, 11)}
    assert got == want
    assert overlap.found(p.limit(0), v.limit(0)).count() == 0
    rep = {(r["split"], r["eval_source"]): r["pairs"] for r in overlap.report(p, v).collect()}
    assert rep[("dev", "a")] == 3


def test_overlap_against_brute_force(spark, monkeypatch):
    """Every pair a comparison of all texts finds, whatever the shards, their division and the bits of the filter."""
    r = random.Random(5)
    stock = [c + "。" for i in range(12) for c in long_text(100 + i, 4).split("。") if c]
    hot = stock[:3]  # sentences a third of all texts have
    texts = []
    for i in range(60):
        t = r.sample(stock, 4) + (hot if i % 3 == 0 else [])
        r.shuffle(t)
        texts.append("".join(t))
    for i in range(40):
        t = list(r.choice(texts))
        for _ in range(r.randint(0, 12)):
            t[r.randrange(len(t))] = r.choice("变更错漏")
        texts.append("".join(t))
    texts += [EN.replace("brand", "band"), EN, "".join(c for c in EN if c.isalpha())[:44] + " . . .", "".join(c for c in EN if c.isalpha())[:44] + "?"]
    rows = [(i, t, "train" if i % 2 else r.choice(["dev", "test_hard"]), "s") for i, t in enumerate(texts)]
    p = spark.createDataFrame(rows, "row_id long, text string, split string, source string")
    v = spark.createDataFrame([], "row_id long, variant_text string, split string, source string")
    norm = {i: overlap.plain(overlap.marked(t)) for i, t, *_ in rows}

    def whole(t, e):
        """The share of the distinct passages of e, by weight, that are in t."""
        ps = {}
        for k, n, w in overlap.passages(overlap.marked(texts[e])):
            ps.setdefault(norm[e][k : k + n], w)
        return sum(w for p, w in ps.items() if p in norm[t]) / max(1, sum(ps.values()))

    want, more = set(), set()
    for i, *_ in rows:
        for j, *_ in rows:
            if i % 2 and not j % 2:
                x, y = sorted((norm[i], norm[j]), key=len, reverse=True)
                if len(y) >= overlap.SHARE * len(x) and overlap.covered(x, y) >= overlap.SHARE and (len(x) > len(y) or overlap.covered(y, x) >= overlap.SHARE):
                    (want if norm[i] == norm[j] or whole(i, j) >= overlap.LEAST else more).add((min(i, j), max(i, j)))
    for shard, chunk, bits in ((500_000, 8_000_000, 30), (900, 2_000, 30), (900, 2_000, 3)):
        monkeypatch.setattr(overlap, "SHARD", shard)
        monkeypatch.setattr(overlap, "CHUNK", chunk)
        monkeypatch.setattr(overlap, "MOST_BITS", max(bits, 12))
        got = [tuple(x) for x in overlap.found(p, v).collect()]
        assert len(got) == len(set(got)) and want <= set(got) <= want | more
    assert len(want) > 20 and len(more) < 0.25 * len(want)


def test_overlap_rounds_bound_the_disk(spark, monkeypatch):
    """A round takes few shards whatever the table, all rounds find what one finds, and only what the result reads stays on disk."""
    r = random.Random(8)
    stock = [c + "。" for i in range(10) for c in long_text(300 + i, 4).split("。") if c]
    texts = ["".join(r.sample(stock, 5)) for _ in range(80)]
    texts += ["".join(r.sample([c + "。" for c in t.split("。") if c], 5)) for t in texts[:40]]
    p = spark.createDataFrame([(i, t, "train" if i < 80 else "dev", "s") for i, t in enumerate(texts + texts[1:5])], "row_id long, text string, split string, source string")
    v = spark.createDataFrame([], "row_id long, variant_text string, split string, source string")
    sc = spark.sparkContext
    blocks = lambda: {str(b) for b in list(sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks())) if str(b).startswith("shuffle_")}
    monkeypatch.setattr(overlap, "SHARD", 900)
    took, each = [], overlap._round
    monkeypatch.setattr(overlap, "_round", lambda index, *more: took.append(index.select("shard").distinct().count()) or each(index, *more))
    got = {}
    for most in (1000, 3):
        monkeypatch.setattr(overlap, "ROUND", most)
        took.clear()
        tables, files = set(sc._scriptorium_cuts), blocks()
        out = overlap.overlaps(p, v)
        assert max(took) <= most and (len(took) > 2) == (most == 3)
        assert sorted(x.rsplit("/", 1)[-1].split("-")[0] for x in set(sc._scriptorium_cuts) - tables) == ["classes", "rows"]
        assert {b for b in blocks() - files} == set()
        got[most] = sorted(tuple(x) for x in out.collect())
    assert got[1000] == got[3] and len(got[3]) > 30
    # no texts at all
    assert overlap.found(p.limit(0), v).count() == 0


def test_passages_tile_the_text():
    for t in (long_text(6), EN, EN[:44], "短。" * 30, long_text(7) + EN, "a" * 41, "…" * 50):
        m = overlap.marked(t)
        norm, tiles = overlap.plain(m), overlap.passages(m)
        assert sum(w for *_, w in tiles) >= 0.75 * len(norm) or len(norm) < 12
        assert all(0 <= i and i + n <= len(norm) and n in overlap.LENGTHS for i, n, _ in tiles)


def test_coverage_measure():
    a = long_text(4)
    assert overlap.covered(a, a) == 1.0 and overlap.covered(a, long_text(5)) < 0.75


# names ----------------------------------------------------------------------------------------------------------------
def test_names(spark):
    reg = spark.createDataFrame([(1, "school", "澄湖工商大学"), (2, "school", "沧原大学"), (3, "school", "穹原大学"), (4, "major", "工商管理硕士"), (5, "major", "会计学")], "entity_id int, kind string, official_name string")
    read = spark.createDataFrame([("杨", "yang"), ("敏", "min"), ("贤", "xian"), ("娴", "xian"), ("李", "li")], "ch string, reading string")
    rows = [
        ("澄湖工商大学", "MBA", "杨敏贤"), ("Chenghu Technology and Business University", "工商管理硕士", "Yang, Minxian"), ("澄工商", "会计", "杨敏娴"), ("工商大学（澄湖）", "会 计 学", "Grace Yang (杨敏贤)"),
        ("苍原大学", None, "未知"), ("沧原大学", "", None), ("穹原大学", "会记学", "/"), (None, None, "李敏"), ("沧原大学", "MBA", "Minxian Yang"),
    ]
    m = spark.createDataFrame(rows, "school string, major string, author string")
    got = {tuple(r) for r in names.found(m, reg, read).collect()}
    school = ["澄湖工商大学", "Chenghu Technology and Business University", "澄工商", "工商大学（澄湖）"]
    want = {("school", *sorted(x)) for i, a in enumerate(school) for x in [(a, b) for b in school[i + 1 :]]} | {("school", *sorted(("苍原大学", "沧原大学")))}
    want |= {("major", "MBA", "工商管理硕士"), *(("major", *sorted(x)) for x in [("会计", "会 计 学"), ("会计", "会记学"), ("会 计 学", "会记学")])}
    author = ["杨敏贤", "Yang, Minxian", "杨敏娴", "Grace Yang (杨敏贤)"]
    want |= {("author", *sorted(x)) for i, a in enumerate(author) for x in [(a, b) for b in author[i + 1 :]]}
    assert got == want  # the namesake of another school stays apart
    assert names.found(m.limit(0), reg, read).count() == 0
    assert names.found(m, reg.limit(0), read.limit(0)).where("field = 'school'").count() == 1  # equal after normalisation


def test_names_lend_until_nothing_merges(spark):
    registry = spark.createDataFrame([(1, "school", "澄湖甲乙丙丁戊大学")], "entity_id int, kind string, official_name string")
    # each spelling differs from the one before by a character: the last is reached in the sixth round
    chain = ["澄湖甲乙丙丁戊大学"]
    for i, c in enumerate("子丑寅卯辰巳"):
        chain.append(chain[-1][: i + 1] + c + chain[-1][i + 2 :])
    values = spark.createDataFrame([(x,) for x in [*chain, "无名天文大学", "无名天文大学 "]], "name string")
    got = {r["name"]: r["entity"] for r in names.resolve_registered(values, registry, "school").collect()}
    assert {got[x] for x in chain} == {"school:1"} and got["无名天文大学"] == got["无名天文大学 "] == "own:无名天文大学"


def test_names_match_again_with_what_merging_gave(spark):
    registry = spark.createDataFrame([(1, "major", "会计学"), (2, "major", "人力资源管理"), (3, "major", "金融学")], "entity_id int, kind string, official_name string")
    resolve = lambda xs: {r["name"]: r["entity"] for r in names.resolve_registered(spark.createDataFrame([(x,) for x in xs], "name string"), registry, "major").collect()}
    # neither is near the official name; each is near a spelling that an earlier round merged
    got = resolve(["会计", "会计硕士", "Human Resource Management", "HRM", "金融"])
    assert got == {"会计": "major:1", "会计硕士": "major:1", "Human Resource Management": "major:2", "HRM": "major:2", "金融": "major:3"}
    assert resolve(["会计硕士", "HRM"]) == {"会计硕士": "own:会计硕士", "HRM": "own:hrm"}


# quality --------------------------------------------------------------------------------------------------------------
def test_quality(spark):
    r = random.Random(3)
    prose = [(i, "".join(r.sample([s + "。" for s in ZH.split("。") if s], 3)) + f"共{i}条记录，供参考。") for i in range(400)]
    odd = [
        (1001, "1. 知识共享\n2. 员工满意\n3. 市场份额\n4. 授权程度\n5. 培训机构"), (1002, "指标\t均值\t占比\n客户黏性\t12.5\t3.1%\n渠道冲突\t8.2\t44%\n库存周转\t5\t6\n人均产值\t7.1\t9"),
        (1003, "◎■$□&@*→■%|#*|←☆&※=@→▼◎×→◇▲←@@▲@÷~@▼#|~▼|…□■+÷■☆^。★□~$#★※%~、~^&+&▲÷"), (1004, None), (1005, ""), (1006, " \n "), (1007, "# 第一章 绪论"), (1008, "图 2-2 服务承诺与离职意愿"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in prose + odd], "row_id long, text string, kind string")
    got = {x["row_id"]: x["kind"] for x in quality.judge(df).collect()}
    assert got == {1001: "list", 1002: "table", 1003: "junk"}
    row = quality.judge(df).where("row_id = 1003").collect()[0]
    assert abs(sum(row["contributions"].values()) - row["distance"]) < 1e-6
    assert quality.judge(df, far=1e9).count() == 0  # nothing but the distance finds them
    assert max(row["contributions"], key=row["contributions"].get) == "symbols"
    assert quality.judge(df.limit(0)).count() == 0
    s = {x["row_id"]: x for x in quality.statistics(df).collect()}
    assert s[1004]["n_chars"] == 0 and s[1005]["n_chars"] == 0 and s[1001]["n_lines"] == 5 and len(s) == len(prose + odd)


def test_prose_is_estimated_for_each_language(spark):
    r = random.Random(4)
    de = "Die Ergebnisse zeigen, dass die Kosten nicht mit der Dauer der Verträge steigen und sich für das Haus lohnen. "
    texts = ["".join(r.sample([x + ". " for x in EN.split(". ") if x.strip()] * 3, 3)) + f"It was seen in {i} of the cases." for i in range(260)] + [de * 2 + f"Das war in {i} Fällen der Fall." for i in range(240)]
    texts += ["".join(r.sample([s + "。" for s in ZH.split("。") if s], 3)) for _ in range(300)]
    texts += ["qwk zrtp lkjw oqpq rtkk ljhg wqpo zzrk tqpl kkjh " * 2, "- awareness of the brand\n- reach in the market / price\n- family firms and their rating\n- stock of the suppliers\n- long leases and the rent"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text string")
    fit = quality.prose(quality.statistics(df).withColumnRenamed("row_id", "id"))
    assert {"en", "de", "zh", "wide", "narrow"} <= set(fit)
    assert abs(fit["de"][0][quality.STATS.index("word_length")] - fit["en"][0][quality.STATS.index("word_length")]) > 0.1
    got = {x["row_id"]: x for x in quality.judge(df).collect()}
    assert quality.measure(["y@B}sFO'czgC|V]'Fk~e?hPB~z>or<*Hds`Pm= e y a o"])["lang"][0] == ""
    assert {k: x["kind"] for k, x in got.items()} == {800: "junk", 801: "list"}


# pairs ----------------------------------------------------------------------------------------------------------------
def test_suffix_automaton():
    r = random.Random(4)
    for _ in range(60):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randint(0, 25))) for _ in range(2))
        want = [max((n for n in range(i + 2) if b[i + 1 - n : i + 1] in a), default=0) for i in range(len(b))]
        assert pairs.SuffixAutomaton(a).matches(b) == want


def test_defects(spark):
    ends = ZH * 4
    cases = [
        (ZH, None, "empty"), (ZH, " \n", "empty"), (ZH, "改写后：", "empty"), (ZH, "（无）", "empty"), (ZH, "N/A", "empty"), (ZH, "```\n```", "empty"),
        (ZH, "抱歉，我无法改写这段文字。", "refusal"), (ZH, "I’m sorry, but I can’t rewrite this.", "refusal"), (ZH, "抱歉，您提供的段落“" + ZH + "”含有无法核实的数据，我不能据此改写。", "refusal"),
        (ZH, "润色后：" + ZH.replace("，", ", "), "copied"), (EN, EN.upper(), "copied"), (ZH, EN * 2, "other_language"), (ZH, "前人研究尚存分歧，关于渠道结构能否影响投诉，", "truncated"),
        (ZH, ends[:40].replace("间接", "直接") + "，一位店长坦言：“我们无法同时顾及两头。”", None), (ZH, ends.replace("关于", "对于").replace("可以考虑", "应当"), None), (None, ends, None), ("", "", "empty"),
    ]
    df = spark.createDataFrame([(i, p, a, "q") for i, (p, a, _) in enumerate(cases)], "row_id long, original_text string, variant_text string, defect string")
    got = {r["row_id"]: r["defect"] for r in pairs.judge(df).collect()}
    assert [got.get(i) for i in range(len(cases))] == [c[2] for c in cases]
    assert pairs.judge(df.limit(0)).count() == 0


def test_refusals_of_any_length():
    prompt = pairs.normal(ZH)
    long_one = "抱歉，我无法改写这段文字。" + "".join(f"原因之{i}是这类请求需要由另外的人员核实之后才能继续办理。" for i in range(20))
    assert pairs.declines(long_one, prompt) and not pairs.declines(ZH * 3 + "企业无法处理的部分另作说明。", prompt)
    assert pairs.coverage("甲乙丙丁戊己庚辛壬癸子丑", "完全不同的文字没有任何相同") == (0.0, 0)


# encoding -------------------------------------------------------------------------------------------------------------
def test_encoding(spark):
    clean = [ZH, EN, ZH + "“façade”与“naïve”两词沿用外文，显著性水平取α=0.05，温度4℃。"] * 60
    bad = [
        ZH.encode().decode("gb18030", "replace"), ZH.encode().decode("latin-1"), ZH.encode("gbk").decode("cp1252", "replace"), ZH[:30] + ZH[30:60].encode().decode("cp1251", "replace") + ZH[60:],
        EN + "The café chain’s résumé took £20.".encode().decode("latin-1"), EN + "The caf茅 chain鈥檚 r茅sum茅 screening.", ZH + "锟斤拷", ZH.encode("gbk").decode("big5", "replace"), ZH.encode().decode("mac_roman"),
    ]
    rows = [(i, t) for i, t in enumerate(clean)] + [(1000 + i, t) for i, t in enumerate(bad)] + [(2000, None), (2001, ""), (2002, " ")]
    got = {r["row_id"]: r for r in encoding.restore(spark.createDataFrame(rows, "row_id long, text string")).collect()}
    assert set(got) == {1000 + i for i in range(len(bad))}
    assert got[1001]["restored"] == ZH and got[1008]["restored"] == ZH and got[1004]["restored"].endswith("The café chain’s résumé took £20.")
    assert encoding.restore(spark.createDataFrame(rows, "row_id long, text string").limit(0)).count() == 0


def test_long_stretches_are_searched(spark):
    t = "关于渠道结构能否间接影响投诉办结时间"
    df = spark.createDataFrame([(i, ZH) for i in range(50)], "row_id long, text string")
    m = lm.PairModel(*lm.pair_table(df))
    items = [b if k % 7 else -1 for k, b in enumerate(t.encode())]
    got = encoding.read_utf8(items, m)
    assert sum(c in t for c in got) >= 0.7 * len(t)


def test_lost_bytes_are_guessed():
    texts = [ZH] * 50
    a, _ = lm.joined(texts)
    n = np.bincount(lm.pair_cells(a[:-1], a[1:]), minlength=lm.CELLS).astype(float)
    m = lm.PairModel(np.where(n > 0, np.minimum(255, 1 + np.round(np.log(np.maximum(n, 1)) * lm.STEP)), 0).astype(np.uint8), float(n.sum()))
    items = list("渠道结构".encode())
    items[4] = -1
    assert encoding.read_utf8(items, m) == "渠道结构"


# tokens ---------------------------------------------------------------------------------------------------------------
def test_tokens(spark):
    enc = tokens.encoder()
    r = random.Random(5)
    texts = [None, "", " ", ZH, EN * 30, "a" * 5000, "".join(r.choice(["  ", "\n\n", "ab", "银行", "！！", "12", "'s", "😀"]) for _ in range(4000)), EN]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, EN, "y")], "doc_id long, text string, ids string")
    rows = tokens.encode(df, long=700).collect()
    assert len(rows) == len(texts) + 1
    for x in rows:
        assert list(x["ids"]) == (enc.encode_ordinary(texts[x["doc_id"]]) if texts[x["doc_id"]] else [])
    assert tokens.encode(df.limit(0)).count() == 0


def test_joined_encodings_are_exact():
    enc = tokens.encoder()
    r = random.Random(6)
    for _ in range(150):
        s = "".join(r.choice([EN[: r.randint(1, 80)], ZH[: r.randint(1, 50)], "x" * r.randint(1, 300), " " * r.randint(1, 60), "\n\n", "…" * 20]) for _ in range(12))
        assert tokens.encode_text(s, enc, long=r.choice([120, 333, 900])) == enc.encode_ordinary(s)


def test_joins_hold_against_hard_texts(spark):
    enc = tokens.encoder()
    r = random.Random(8)
    bits = ["'s", "'", "s", "'ll", " ", "  ", "\t", "\n", "\r\n", "a", "aaaa", "Ａ", "1", "²", "é", "e\u0301", "，", "。", "…", "_", "-", "😀", "的", "the", "\u00a0", "\u3000", "'re"]
    for _ in range(400):
        s = "".join(r.choice(bits) for _ in range(60))
        i = r.randint(0, len(s))
        assert tokens.join_encoded(enc, s[:i], enc.encode_ordinary(s[:i]), s[i:], enc.encode_ordinary(s[i:])) == enc.encode_ordinary(s)
    df = spark.createDataFrame([(1, "a" * 3000), (2, " " * 3000), (3, "ab " * 3000), (4, "的" * 3000)], "doc_id long, text string")
    # several levels of joins
    assert {x["doc_id"]: list(x["ids"]) for x in tokens.encode(df, long=20).collect()} == {x["doc_id"]: enc.encode_ordinary(x["text"]) for x in df.collect()}


# mixing ---------------------------------------------------------------------------------------------------------------
def test_mixing(spark):
    docs = [(i, "a" if i % 3 else "b", EN) for i in range(900)] + [(5000, None, EN), (5001, "zz", EN), (5002, "a", None), (5003, "a", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 2), ("none", 0.2, 4)], "source string, target_share double, max_repeats int")
    out, rep = mixing.mix(df, t, block_tokens=200, shard_blocks=8)
    r = {x["source"]: x for x in rep.collect()}
    assert abs(r["a"]["actual_share"] - 0.5) < 0.02 and abs(r["b"]["actual_share"] - 0.5) < 0.02
    assert r["none"]["actual_share"] == 0 and r["zz"]["target_share"] == 0 and r["b"]["repeats"] <= 2.0
    rows = out.collect()
    assert len({(x["doc_id"], x["copy"]) for x in rows}) == len(rows) and {x["source"] for x in rows} == {"a", "b"}
    assert sum(x["n_tokens"] for x in rows) == r["a"]["mixed_tokens"] + r["b"]["mixed_tokens"]
    assert len({(x["shard"], x["position"]) for x in rows}) == len(rows)


def test_mixing_with_one_giant_text(spark):
    docs = [(i, "a", EN) for i in range(300)] + [(1000 + i, "b", EN) for i in range(100)] + [(2000, "b", EN * 90)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 1)], "source string, target_share double, max_repeats int")
    for seed in range(3):
        _, rep = mixing.mix(df, t, seed=seed, block_tokens=200, shard_blocks=8)
        assert all(abs(x["actual_share"] - x["target_share"]) < 0.01 for x in rep.collect())


def test_splitting_tree_is_exact():
    q = np.array([70, 13, 0, 41])
    shards = 9
    paths = [mixing.draw_path(q, shards, i, 3) for i in range(shards)]
    assert (sum(p[1] for p in paths) == q).all()
    for i in range(1, shards):
        assert (paths[i][0] == paths[i - 1][0] + paths[i - 1][1]).all()


# language -------------------------------------------------------------------------------------------------------------
def test_language(spark):
    de, ru, ja = "Weder das Anreizsystem noch die Lieferantenauswahl genügt allein, um den Erfolg zu sichern.", "Из опрошенных большинство считает, что система требует пересмотра.", "物流事業者は情報共有を重視する一方で、離職率を十分に把握していなかった。"
    rows = [
        (1, ZH, "zh_CN"), (2, ZH, None), (3, EN, "de"), (4, ZH + "\n\n" + EN * 2, "en"), (5, ja, "Japanese"), (6, ru, "und"), (7, de, "German"), (8, None, "zh"), (9, " ", None), (10, "123", ""),
        (11, "其中Customer Lifetime Value被用来衡量市场细分，并一同进入模型。", "中文"), (12, de + "\r\n \r\n" + ru, "de"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {tuple(r) for r in language.found(df).collect()}
    assert got == {(2, -1, "zh"), (3, -1, "en"), (4, 0, "zh"), (4, 1, "en"), (6, -1, "ru"), (12, 0, "de"), (12, 1, "ru")} or got - {(12, -1, "ru")} == {(2, -1, "zh"), (3, -1, "en"), (4, 0, "zh"), (4, 1, "en"), (6, -1, "ru"), (12, 0, "de"), (12, 1, "ru")}
    assert all(0 <= r["confidence"] <= 1 for r in language.detect(df).collect())
    assert language.found(df.limit(0)).count() == 0


def test_labels(spark):
    vals = ["zh-CN", " ZH ", "chinese", "en_GB", "英文", "und", "", None, "xx", "ko", "Zh "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, l string")
    assert [r["k"] for r in df.select("i", language.label(F.col("l")).alias("k")).orderBy("i").collect()] == ["zh", "zh", "zh", "en", "en", None, None, None, None, None, "zh"]


def test_queries_exist():
    from scriptorium.llm.queries import QUERIES

    for n in range(1, 11):
        assert any(k.startswith(f"p{n}_") for k in QUERIES)
    assert dt.date.today()
