"""Documents into ordered paragraphs with type, chapter, role and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.text import count_of, lines, matches, newlines, pieces, rx, strip


def is_header(c: Column) -> Column:
    return matches(strip(c), *P.HEADER)


def is_dropped(c: Column) -> Column:
    return matches(strip(c), *("(?i)" + p for p in P.DROPPED))


def paragraph_type(c: Column) -> Column:
    """Types in the order their rules apply."""
    s = strip(c)
    n = F.length(s)
    return (
        F.when(matches(s, rf"^摘要{P.WS}*$", rf"(?i)^ABSTRACT{P.WS}*$"), "abstract")
        .when(matches(s, rf"^表{P.WS}*(?:{P.DIGIT}|-)+(?:[.、]|{P.WS})", rf"^表{P.WS}*{P.DIGIT}+{P.WS}+[^。]{{1,30}}$"), "table_note")
        .when(matches(s, rf"^图{P.WS}*(?:{P.DIGIT}|-)+(?:[.、]|{P.WS})", rf"^图{P.WS}*{P.DIGIT}+{P.WS}+[^。]{{1,30}}$"), "figure_note")
        .when(matches(s, rf"^公式{P.WS}*(?:{P.DIGIT}|[(\[])", rf"^式{P.WS}*[(\[]{P.WS}*{P.DIGIT}+") | (matches(s, rf"^\({P.WS}*{P.DIGIT}+{P.WS}*\)") & (n < 50)), "formula_note")
        .when(matches(s, rf"^{P.DIGIT}+、{P.WS}", rf"^\({P.DIGIT}+\){P.WS}"), "list_like")
        .when(matches(s, rf"^{P.DIGIT}+\.{P.WS}+{P.NWS}"), F.when(n > 40, "list_like").otherwise("heading"))
        .when(matches(s, "^[①②③④⑤⑥⑦⑧⑨⑩]", "^[•·◆◇○●]"), "list_like")
        .otherwise("normal")
    )


def chapter_role(chapter: Column, kind: Column | None = None) -> Column:
    """The first role one of whose words the chapter title holds."""
    low = F.lower(chapter)
    out = F.when(kind == "abstract", "abstract") if kind is not None else None
    for role, words in P.ROLES.items():
        hit = reduce(lambda a, b: a | b, (low.contains(w) for w in words))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("other")


def has_citation(c: Column) -> Column:
    return matches(c, P.CITATION)


def has_formula(c: Column) -> Column:
    return matches(c, P.FORMULA) | c.contains("公式")


def has_table_ref(c: Column) -> Column:
    return matches(c, P.TABLE_REF)


def has_figure_ref(c: Column) -> Column:
    return matches(c, P.FIGURE_REF)


def sentence_count(c: Column) -> Column:
    return F.size(pieces(c, P.SENTENCE_END))


def segment(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """All paragraphs of all documents. One exchange, by document: every window and the regrouping share its partitioning."""
    key = [id_col, *extra]
    ls = df.select(*key, F.posexplode(lines(newlines(F.coalesce(F.col(text_col), F.lit(""))))).alias("pos", "raw")).select(*key, "pos", strip(F.col("raw")).alias("line"))
    ls = ls.withColumn("header", is_header(F.col("line"))).withColumn("blank", F.col("line") == "")
    doc = Window.partitionBy(id_col).orderBy("pos")
    ls = ls.withColumn("g", F.sum((F.col("header") | F.col("blank")).cast("int")).over(doc)).where("NOT blank")
    units = ls.groupBy(id_col, *extra, "g", "header").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    units = units.withColumn("text", F.array_join(F.transform("ls", lambda x: x["line"]), " ")).drop("ls")
    units = units.where(F.col("header") | ~is_dropped(F.col("text")))
    title = F.when(F.col("header"), strip(F.regexp_replace("text", "^#+", "")))
    units = units.withColumn("chapter", F.coalesce(F.last(title, ignorenulls=True).over(doc), F.lit(P.UNKNOWN_CHAPTER)))
    units = units.withColumn("anchor", F.col("header") | (F.length("text") >= P.SHORT_BODY) | (F.row_number().over(doc) == 1))
    units = units.withColumn("para_index", F.sum(F.col("anchor").cast("int")).over(doc).cast("int"))
    rows = units.groupBy(id_col, *extra, "para_index").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min_by("text", "pos").alias("own"), F.min_by("chapter", "pos").alias("chapter"), F.min_by("header", "pos").alias("header"),
    )
    # fragments joined later change text and length only
    own, head = F.col("own"), F.col("header")
    return rows.select(
        *key, "para_index", "text", "chapter",
        F.when(head, "heading").otherwise(paragraph_type(own)).alias("para_type"),
        F.when(F.col("chapter") == P.UNKNOWN_CHAPTER, "other").otherwise(chapter_role(F.col("chapter"))).alias("chapter_role"),
        F.length("text").alias("char_count"),
        F.when(head, F.length(own)).otherwise(count_of(own, P.HAN)).alias("word_count"),
        F.when(head, F.lit(0)).otherwise(sentence_count(own)).alias("sentence_count"),
        (~head & has_citation(own)).alias("has_citation"), (~head & has_formula(own)).alias("has_formula"),
        (~head & has_table_ref(own)).alias("has_table_ref"), (~head & has_figure_ref(own)).alias("has_figure_ref"),
    )


def keep_lengths(paragraphs: DataFrame, shortest: int = P.MIN_LENGTH, longest: int = P.MAX_LENGTH) -> DataFrame:
    """Rows of a usable length; numbering keeps its gaps."""
    return paragraphs.where(F.col("char_count").between(shortest, longest))


def distributions(paragraphs: DataFrame) -> DataFrame:
    """(dimension, value, n) of type, role and year in one aggregation."""
    g = paragraphs.groupingSets([["para_type"], ["chapter_role"], ["year"]], "para_type", "chapter_role", "year").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    return g.select(
        F.when(F.col("gid") == 3, "para_type").when(F.col("gid") == 5, "chapter_role").otherwise("year").alias("dimension"),
        F.when(F.col("gid") == 3, F.col("para_type")).when(F.col("gid") == 5, F.col("chapter_role")).otherwise(F.col("year").cast("string")).alias("value"), "n")


def split_for_scoring(c: Column, shortest: int = 100, longest: int = 1000) -> Column:
    """Paragraphs for the scorer: by blank lines; if fewer than five fit, also packed from sentences up to 200 characters."""
    parts = F.transform(F.split(c, rx(rf"\n{P.WS}*\n"), -1), lambda x: F.regexp_replace(strip(x), rf"{P.WS}+", " "))
    kept = F.filter(parts, lambda x: F.length(x).between(shortest, longest))
    sentences = F.filter(F.transform(F.split(c, rx("(?<=[。！？])"), -1), strip), lambda x: x != "")

    def step(acc: Column, s: Column) -> Column:
        cur = F.concat(acc["cur"], s)
        full = F.length(cur) >= 200
        return F.struct(
            F.when(full & (F.length(cur) <= longest), F.concat(acc["out"], F.array(cur))).otherwise(acc["out"]).alias("out"),
            F.when(full, F.lit("")).otherwise(cur).alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    packed = F.aggregate(sentences, start, step, lambda a: F.when(F.length(a["cur"]) >= shortest, F.concat(a["out"], F.array(F.substring(a["cur"], 1, longest)))).otherwise(a["out"]))
    return F.when(F.size(kept) < 5, F.concat(kept, packed)).otherwise(kept)
