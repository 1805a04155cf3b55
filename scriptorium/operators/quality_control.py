"""Quality measures of documents and the report made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.text import count_chars, fixed, matches, ratio, strip
from scriptorium.operators.cleaning import clean, dirty

ISSUE = "struct<type:string,desc:string,location:string,severity:string>"


def chinese_ratio(c: Column) -> Column:
    return ratio(count_chars(c, P.HAN), F.length(strip(c)))


def garbled_ratio(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.lit(1.0) - count_chars(c, f"[{P.VALID}]").cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def has_chapters(c: Column) -> Column:
    return matches(c, P.CHAPTER_ANYWHERE, *P.CHAPTER_LINE)


def has_ending(c: Column) -> Column:
    a, b, d = P.ENDINGS
    return c.contains(a) | c.contains(b) | c.contains(d)


def paragraph_kind(c: Column) -> Column:
    """The conservative paragraph types of quality control."""
    s = strip(c)
    return (
        F.when(matches(s, rf"^#{{1,6}}{P.WS}+", rf"^第{P.NUMERAL}+章"), "heading")
        .when(matches(s, rf"^摘要{P.WS}*$"), "abstract")
        .when(matches(s, rf"^表(?:{P.WS}|{P.DIGIT})"), "table_note")
        .when(matches(s, rf"^图(?:{P.WS}|{P.DIGIT})"), "figure_note")
        .when(matches(s, rf"^公式(?:{P.WS}|{P.DIGIT})", r"^式\("), "formula_note")
        .when(matches(s, "^参考文献"), "reference")
        .otherwise("normal")
    )


def needs_model_fix(text: Column, garbled: Column) -> Column:
    return dirty(text) | (garbled > P.ERROR_GARBLED)


def _percent(c: Column) -> Column:
    return F.concat(fixed(c * 100.0, 2), F.lit("%"))


def check(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Measures, issues and status of each text, as it stands."""
    t = F.col(text_col)
    d = df.withColumn("char_count", F.length(t)).withColumn("chinese_ratio", chinese_ratio(t)).withColumn("garbled_ratio", garbled_ratio(t))
    d = d.withColumn("has_chapter_structure", has_chapters(t)).withColumn("has_valid_ending", has_ending(t))

    def issue(kind: str, desc: Column, severity: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), desc.alias("desc"), F.lit("全文").alias("location"), severity.alias("severity"))

    warn = F.lit("warning")
    found = F.array(
        F.when(F.col("garbled_ratio") > P.MAX_GARBLED, issue("garbled_ratio", F.concat(F.lit("乱码比例 "), _percent(F.col("garbled_ratio"))), F.when(F.col("garbled_ratio") > P.ERROR_GARBLED, "error").otherwise("warning"))),
        F.when(F.col("chinese_ratio") < P.MIN_CHINESE, issue("low_chinese_ratio", F.concat(F.lit("中文比例 "), _percent(F.col("chinese_ratio"))), warn)),
        F.when(F.col("char_count") < P.MIN_CHARS, issue("low_char_count", F.concat(F.lit("字数 "), F.col("char_count").cast("string")), warn)),
        F.when(~F.col("has_chapter_structure"), issue("missing_chapter_structure", F.lit("缺少章节结构"), warn)),
        F.when(~F.col("has_valid_ending"), issue("invalid_ending", F.lit("缺少参考文献/致谢/附录"), warn)),
    )
    d = d.withColumn("issues", F.filter(found, lambda x: x.isNotNull()))
    d = d.withColumn("needs_model_fix", needs_model_fix(t, F.col("garbled_ratio")))
    return d.withColumn("status", F.when(F.size("issues") == 0, "passed").when(F.exists("issues", lambda x: x["severity"] == "error"), "error").otherwise("warning"))


def process(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Clean, then check what is left; any fix makes the status `fixed`, whatever it was. Unreadable texts (null) are errors."""
    d = check(clean(df, text_col, "cleaned"), "cleaned")
    d = d.withColumn("status", F.when(F.col(text_col).isNull(), "error").when(F.size("fixes_applied") > 0, "fixed").otherwise(F.col("status")))
    return d


def summary(reports: DataFrame) -> DataFrame:
    """One row: documents by status and those that need a model."""
    return reports.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("passed", "warning", "fixed", "error")), F.count_if("needs_model_fix").alias("needs_model"))
