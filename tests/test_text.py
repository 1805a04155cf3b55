"""Column helpers against the functions of Python they follow."""

import random
import re

from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.text import count_of, count_sub, distinct_chars, pieces, strip
from scriptorium.operators.cleaning import close_script_gaps, drop_page_furniture, fix_garbled, merge_spaced_letters, squeeze_spaces


def strings(n=400, seed=1):
    r = random.Random(seed)
    alphabet = list("abAB 一二研究。！？；,.\n\t　 \x1c12第3页") + ["A B C D", "第 3 页", "大学", "\n\n\n", "  ", "&amp;", "。。。", "�", "\x07", "https://x"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


def run(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_strip_and_counts(spark):
    ts = strings()
    assert run(spark, strip, ts) == [t.strip() for t in ts]
    assert run(spark, lambda c: count_of(c, P.HAN), ts) == [len(re.findall("[一-鿿]", t)) for t in ts]
    assert run(spark, lambda c: count_sub(c, "一二"), ts) == [t.count("一二") for t in ts]
    assert run(spark, distinct_chars, ts) == [len(set(t)) for t in ts]
    assert run(spark, lambda c: F.size(pieces(c, P.SENTENCE_END)), ts) == [len([s for s in re.split(r"[。！？；.!?]", t) if s.strip()]) for t in ts]


def test_spaced_letters(spark):
    ts = strings(600, 2) + ["A B C D", "A B C", "xA B C D", "A B C D E f", "a b c d1"]
    want = [re.sub(r"\b([A-Za-z](?:\s[A-Za-z]){3,})\b", lambda m: "".join(m.group(1).split()) if " " in m.group(1) or True else m.group(1), t) for t in ts]
    got = run(spark, merge_spaced_letters, ts)
    assert sum(a != b for a, b in zip(got, want)) <= 0.01 * len(ts)  # the class of white space differs in four control characters
    assert run(spark, merge_spaced_letters, ["A B C D", "A B C"]) == ["ABCD", "A B C"]


def test_cleaning_steps(spark):
    ts = strings(400, 3)
    assert run(spark, squeeze_spaces, ts) == [re.sub("\n{3,}", "\n\n", re.sub(r" {2,}", " ", t).replace(" \n", "\n").replace("\n ", "\n")) for t in ts]
    assert run(spark, fix_garbled, ["好。。。", "a&amp;b&#x27;", "x�y\x07"]) == ["好。。", "ab'", "xy"]
    assert run(spark, drop_page_furniture, ["第 3 页\n正文\n12\nXIV\n12345\nhttps://a b\n某某大学硕士学位论文"]) == ["正文\n12345"]
    assert run(spark, close_script_gaps, ["研究 A 与 3 家\n企业 x"]) == ["研究A与3家\n企业x"]


def test_nulls_and_empty(spark):
    assert run(spark, strip, ["", " "]) == ["", ""]
    assert run(spark, distinct_chars, [""]) == [0]


def test_fixed_rounds_as_python_does(spark):
    import random

    from pyspark.sql import functions as F

    from scriptorium.functions.text import fixed

    r = random.Random(1)
    vs = [0.0, 0.5, 15.625, 15.375, 1.015, 22.05, 22.15, 19.25, 99.995, 100.0, *(r.random() * 100 for _ in range(300)), *(r.randrange(20001) / 200 for _ in range(300))]
    for digits in (1, 2, 3):
        got = [x["f"] for x in spark.createDataFrame([(v,) for v in vs], "v double").select(fixed(F.col("v"), digits).alias("f")).collect()]
        assert got == [f"{v:.{digits}f}" for v in vs]
