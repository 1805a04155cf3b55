"""Rule-based cleaning of document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.text import lines, matches, rx, strip

#: Names of the operations, in the order they run in (fixed values).
OPERATIONS = ("页眉页脚删除", "字母间距修复", "乱码清理", "多余空格清理")


def drop_page_furniture(c: Column) -> Column:
    def furniture(line: Column) -> Column:
        s = strip(line)
        return matches(s, *P.FURNITURE) | (matches(s, P.PAGE_NUMBER) & (F.length(s) < P.PAGE_NUMBER_BELOW))

    return F.array_join(F.filter(lines(c), lambda x: ~furniture(x)), "\n")


def merge_spaced_letters(c: Column) -> Column:
    """Runs of four and more single letters lose the white space between them."""
    return F.regexp_replace(c, r"(?U)(?:\b(?=(?:[A-Za-z]\s){3,}[A-Za-z]\b)|(?!^)\G)([A-Za-z])\s(?=[A-Za-z]\b)", "$1")


def close_script_gaps(c: Column) -> Column:
    """White space between ideographs and Latin letters or digits goes."""
    c = F.regexp_replace(c, rf"({P.HAN}){P.WS}+([a-zA-Z0-9])", "$1$2")
    return F.regexp_replace(c, rf"([a-zA-Z0-9]){P.WS}+({P.HAN})", "$1$2")


def fix_garbled(c: Column) -> Column:
    c = F.replace(c, F.lit("&#x27;"), F.lit("'"))
    c = F.regexp_replace(c, "&[a-zA-Z]+;", "")
    c = F.regexp_replace(c, P.CONTROL, "")
    c = F.replace(c, F.lit("�"), F.lit(""))
    return F.regexp_replace(c, P.DOUBLED_END, "$1")


def squeeze_spaces(c: Column) -> Column:
    c = F.regexp_replace(c, " {2,}", " ")
    c = F.replace(c, F.lit(" \n"), F.lit("\n"))
    c = F.replace(c, F.lit("\n "), F.lit("\n"))
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def clean(df: DataFrame, text_col: str = "text", out: str = "cleaned") -> DataFrame:
    """The cleaned text and the names of the operations that changed it, each step computed once."""
    d = df.withColumn("_0", F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn("_1", drop_page_furniture(F.col("_0")))
    d = d.withColumn("_2", merge_spaced_letters(F.col("_1")))
    d = d.withColumn("_3", close_script_gaps(F.col("_2")))
    d = d.withColumn("_4", fix_garbled(F.col("_3")))
    d = d.withColumn("_5", squeeze_spaces(F.col("_4")))
    # closing script gaps does not count as a fix
    flags = [F.col("_1") != F.col("_0"), F.col("_2") != F.col("_1"), F.col("_4") != F.col("_3"), F.col("_5") != F.col("_4")]
    names = F.filter(F.array(*(F.when(f, F.lit(n)) for f, n in zip(flags, OPERATIONS))), lambda x: x.isNotNull())
    return d.withColumn(out, F.col("_5")).withColumn("fixes_applied", names).drop(*(f"_{i}" for i in range(6)))


def dirty(c: Column) -> Column:
    """Text a model would have to repair: structural damage that rules leave."""
    return matches(c, *P.DIRTY)


__all__ = ["OPERATIONS", "clean", "close_script_gaps", "dirty", "drop_page_furniture", "fix_garbled", "merge_spaced_letters", "rx", "squeeze_spaces"]
