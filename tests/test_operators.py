"""Literal cases and invariants of the core operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.operators import evaluation, features, fusion, metadata, quality_control, segmentation, splitting, training, variants
from scriptorium.plans import pipelines


def col(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_paragraph_types(spark):
    ts = ["表 1 样本", "式(3)", "(1) 短", "①首先", "1. 短标题", "1. " + "长" * 41, "图 2 变量", "摘要", "正文。"]
    assert col(spark, segmentation.paragraph_type, ts) == ["table_note", "formula_note", "formula_note", "list_like", "heading", "list_like", "figure_note", "abstract", "normal"]


def test_roles(spark):
    ts = ["数据分析", "参考文献", "文献综述", "第五章 结论", "调查问卷", "别的"]
    assert col(spark, segmentation.chapter_role, ts) == ["methodology", "reference", "literature", "conclusion", "methodology", "other"]


def test_segment_literal(spark):
    df = spark.createDataFrame([(1, "# 绪论\n短句\n\n这是足够长的一个正文段落内容。"), (2, ""), (3, None)], "doc_id int, text string")
    rows = segmentation.segment(df).orderBy("doc_id", "para_index").collect()
    assert [(r["para_index"], r["para_type"], r["text"]) for r in rows] == [(1, "heading", "# 绪论 短句"), (2, "normal", "这是足够长的一个正文段落内容。")]
    assert rows[1]["chapter"] == "绪论" and rows[1]["chapter_role"] == "intro"


def naive_segments(text):
    """A stateful restatement: (index, text)."""
    header = re.compile(r"#{1,6}\s+|第[一二三四五六七八九十\d]+[章节篇]|\d+\.\d+(\.\d+){0,2}\s+\S")
    out, buf, n = [], [], 0

    def flush():
        nonlocal n
        if buf:
            t = " ".join(buf)
            buf.clear()
            if re.match(r"\s*目录\s*$", t):
                return
            if len(t) < 15 and out:
                out[-1][1] += " " + t
                return
            n += 1
            out.append([n, t])

    for line in text.split("\n"):
        line = line.strip()
        if header.match(line):
            flush()
            n += 1
            out.append([n, line])
        elif not line:
            flush()
        else:
            buf.append(line)
    flush()
    return [tuple(x) for x in out]


def test_segment_random(spark):
    r = random.Random(5)
    parts = ["# 标题", "第一章 绪论", "1.1 小节", "短", "这是一个足够长的正文句子用来测试。", "", "", "目录", "  空格行  ", "3.14 数"]
    docs = [(i, "\n".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(120)]
    got = {}
    for x in segmentation.segment(spark.createDataFrame(docs, "doc_id int, text string")).orderBy("doc_id", "para_index").collect():
        got.setdefault(x["doc_id"], []).append((x["para_index"], x["text"]))
    for i, t in docs:
        assert got.get(i, []) == naive_segments(t), t


def test_scoring_split(spark):
    r = random.Random(6)

    def naive(text, lo=100, hi=1000):
        out = [re.sub(r"\s+", " ", p.strip()) for p in re.split(r"\n\s*\n", text)]
        out = [p for p in out if lo <= len(p) <= hi]
        if len(out) < 5:
            cur = ""
            for s in re.split(r"(?<=[。！？])", text):
                cur += s.strip()
                if len(cur) >= 200:
                    if len(cur) <= hi:
                        out.append(cur)
                    cur = ""
            if len(cur) >= lo:
                out.append(cur[:hi])
        return out

    ts = ["".join(r.choice(["研究" * 30 + "。", "短。", "\n\n", "空 格 ", "长" * 150]) for _ in range(r.randint(0, 12))) for _ in range(80)]
    assert col(spark, segmentation.split_for_scoring, ts) == [naive(t) for t in ts]


def test_paths(spark):
    ps = ["/c/2016/a/a.md", "/c/2016/a.md", "/c/x/t2019y.md", "/c/x/y.md", "/2016/论文/论文.md"]
    assert col(spark, metadata.year_of_path, ps) == [2016, 2016, 2019, 0, 2016]
    assert col(spark, metadata.year_of_parent, ps) == [0, 2016, 0, 0, 0]
    assert col(spark, metadata.stem, ps)[0] == "a"


def test_quality_control(spark):
    df = spark.createDataFrame([(1, "第一章 绪论\n" + "研究方法。" * 250 + "参考文献"), (2, "12\nabc���"), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in quality_control.process(df).collect()}
    assert got[1]["status"] == "passed" and got[1]["fixes_applied"] == []
    assert got[2]["status"] == "fixed" and got[2]["fixes_applied"] == ["页眉页脚删除", "乱码清理"]
    assert got[3]["status"] == "error"


def test_hard_samples_cap(spark):
    rows = [(i, f"d{i % 3}", "train", 100, True, False, "findings", "normal") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, doc_id string, split string, char_count int, has_citation boolean, has_formula boolean, chapter_role string, para_type string")
    h = splitting.hard_samples(df, 0.3)
    assert h.count() == 60
    # 18 candidates, 6 a document, of which half are kept
    assert h.where("hard").groupBy("doc_id").count().select("count").distinct().collect()[0][0] == 3


def test_moves(spark):
    v = spark.createDataFrame([(1, "a", "t1", "x", 0, "train"), (2, "a", "t1", "x", 2022, "train"), (3, "a", "t1", "x", 2022, "dev"), (4, "b", "t2", "x", 2022, "train"), (5, "b", "t2", "x", 2022, "train")], "row_id long, doc_id string, original_text string, variant_type string, year int, split string")
    out = {r["row_id"]: r["final_split"] for r in splitting.moved(v).collect()}
    assert out == {1: "train", 3: "dev", 4: "dev"}


def test_fusion_cases(spark):
    df = spark.createDataFrame([(1, 0.2, 0.6, 0.9, 0.1, 0.1), (2, 0.1, 0.3, 0.3, 0.2, 0.1)], "i int, " + ", ".join(f"{m} double" for m in P.MODELS))
    a, b = fusion.fuse(df, 0.35).orderBy("i").collect()
    assert (a["is_ai"], a["confidence"], a["triggered_by"], len(a["all_model_probs"])) == (True, 0.6, "select10_tree_d2", 2)
    assert (b["is_ai"], b["confidence"], b["triggered_by"]) == (False, 0.3, "none")
    c = spark.createDataFrame([(1, 0.5, 0.5, 0.3, 0.2, 0.4)], "i int, " + ", ".join(f"{m} double" for m in P.MODELS))
    r = fusion.fuse_calibrated(c).collect()[0]
    assert (r["is_ai"], r["raw_probability"], round(r["calibrated_score"], 6), r["triggered_by"]) == (False, 0.5, 0.15, "select5_tree_d2")
    f = fusion.Fusion("strict")
    assert f.threshold == 0.45
    with pytest.raises(ValueError):
        f.set_threshold(2)
    with pytest.raises(ValueError):
        f.set_mode("x")
    assert "✓" in fusion.fuse(df).select(fusion.explain(df).alias("e")).collect()[0]["e"]


def test_online_features(spark):
    r = features.with_online(spark.createDataFrame([("我们研究。",), ("",), (None,)], "text string")).collect()
    assert (r[0]["avg_sentence_length"], r[0]["sentence_length_std"], r[0]["period_ratio"], r[0]["pronoun_ratio"], r[0]["formality_score"], r[0]["unique_word_ratio"]) == (4.0, 0.0, 0.2, 0.4, 0.2, 1.0)
    assert r[1]["avg_word_length"] == 0.0 and r[2]["digit_ratio"] == 0.0


def test_auc_matches_pairs(spark):
    r = random.Random(3)
    rows = [("m", "s", "hard", r.randint(0, 1), r.randint(0, 9) / 10) for _ in range(200)]
    df = spark.createDataFrame(rows, "model string, split string, difficulty string, y int, p double").withColumn("pred", (F.col("p") > 0.5).cast("int"))
    pos, neg = [x[4] for x in rows if x[3]], [x[4] for x in rows if not x[3]]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(evaluation.auc(df, ["model"]).collect()[0]["auc"] - want) < 1e-9
    one = df.where("y = 1")
    assert evaluation.auc(one, ["model"]).collect()[0]["auc"] is None


def test_trees_as_expressions(spark):
    r = random.Random(4)
    rows = [([r.random() for _ in range(30)],) for _ in range(200)]
    df = spark.createDataFrame(rows, "features array<double>").withColumn("label", (F.col("features")[3] > 0.5).cast("int"))
    for name in ("select5_tree_d2", "bert_tree_d1"):
        pipe = training.fit_tree(df, name)
        got = training.score_trees(df, {m: training.tree_spec(pipe) for m in P.MODELS}).select(P.MODELS[0]).collect()
        want = training.score(pipe, df).select("p").collect()
        assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(got, want))


def test_variants_policy():
    p = variants.ErrorPolicy()
    assert [p.record("a", 500) for _ in range(3)] == [False, False, True]
    p.activate("s", now=0.0)
    assert p.active("s", now=539.0) and not p.active("s", now=541.0)
    assert variants.slot_provider(1, ("a", "b", "c"), 0.0, 901.0) == "c"


def test_detect_end_to_end(spark):
    docs = spark.createDataFrame([("a", ("企业管理研究方法与分析策略。" * 12 + "\n\n") * 6), ("b", "短")], "doc_id string, text string")
    leaf = {"feature": 0, "threshold": 1000.0, "left": {"p": 0.6}, "right": {"p": 0.1}}
    out = {r["doc_id"]: r for r in pipelines.detect(docs, {m: leaf for m in P.MODELS}).collect()}
    assert round(out["a"]["doc_calibrated_score"], 6) == 0.18 and out["a"]["risk_level"] == "中风险"
