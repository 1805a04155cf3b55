"""One row of metadata for each document, read from its text and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.text import lines, matches, rx, strip

FIELDS = ("year", "title", "school", "major", "author")


def paper_hash(c: Column) -> Column:
    """A stable key: half the digest of the first 2000 characters."""
    return F.substring(F.sha2(F.encode(F.substring(c, 1, 2000), "UTF-8"), 256), 1, 16)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _folder(path: Column, up: int) -> Column:
    return F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(up)), F.lit(""))


def year_of_parent(path: Column) -> Column:
    """The parent folder's name if it is a number, else 0."""
    p = _folder(path, 1)
    return F.when(p.rlike("^[0-9]{1,9}$"), p.cast("int")).otherwise(F.lit(0))


def year_of_path(path: Column) -> Column:
    """The grandparent's or parent's name if it is a year, else the first year in the file name, else 0."""

    def year(c: Column) -> Column:
        n = F.when(c.rlike("^[0-9]{4}$"), c.cast("int"))
        return F.when(n.between(2000, 2030), n)

    return F.coalesce(year(_folder(path, 2)), year(_folder(path, 1)), F.nullif(F.regexp_extract(stem(path), r"(20[0-9]{2})", 1), F.lit("")).cast("int"), F.lit(0))


def title(c: Column) -> Column:
    heads = F.transform(F.slice(lines(c), 1, 50), lambda x: strip(x))
    named = F.transform(F.filter(heads, lambda x: x.startswith("# ")), lambda x: strip(F.substring(x, 3, 1_000_000)))
    return F.coalesce(F.get(F.filter(named, lambda x: (F.length(x) > 5) & (F.length(x) < 100)), F.lit(0)), F.lit(""))


def _first(c: Column, patterns: tuple[str, ...], passes, tidy=lambda x: x, words: tuple[str, ...] | None = None) -> Column:
    """The first extract that passes, line by line, pattern by pattern within a line; a pattern runs only where the word it needs occurs."""

    def extracts(x: Column) -> Column:
        out = [tidy(F.regexp_extract(x, rx(p), 1)) for p in patterns]
        if words:
            out = [F.when(x.contains(w), e).otherwise(F.lit("")) for w, e in zip(words, out)]
        return F.array(*out)

    found = F.flatten(F.transform(F.slice(lines(c), 1, 100), extracts))
    return F.coalesce(F.get(F.filter(found, passes), F.lit(0)), F.lit(""))


def school(c: Column) -> Column:
    return _first(c, P.SCHOOL, lambda x: (F.length(x) > 4) & ~x.contains("专业") & ~x.contains("班级"), words=("大学", "学院", "研究院"))


def major(c: Column) -> Column:
    return _first(c, P.MAJOR, lambda x: x != "", strip)


def author(c: Column) -> Column:
    return _first(c, P.AUTHOR, lambda x: F.length(x).between(2, 10), strip)


def chapter_count(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: matches(strip(x), P.CHAPTER_HEAD)))


def extract(docs: DataFrame, paragraphs: DataFrame | None = None, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Metadata of every document; with paragraphs, of those that have some, with their number."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(
        F.col(id_col).alias("doc_id"), paper_hash(t).alias("paper_hash"), year_of_path(F.col(path_col)).alias("year"), title(t).alias("title"), school(t).alias("school"),
        major(t).alias("major"), author(t).alias("author"), F.length(t).alias("char_count"), chapter_count(t).alias("chapter_count"), F.col(path_col).alias("source_path"))
    d = d.withColumn("source_doc_id", F.when(F.col("year") > 0, F.concat_ws("_", F.col("year").cast("string"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")))
    missing = F.filter(F.array(F.when(F.col("year") == 0, "year"), *(F.when(F.col(f) == "", f) for f in FIELDS[1:])), lambda x: x.isNotNull())
    d = d.withColumn("missing_fields", missing).withColumn("has_complete_metadata", F.size("missing_fields") == 0)
    if paragraphs is None:
        return d
    return d.join(paragraph_counts(paragraphs, id_col), "doc_id")


def paragraph_counts(paragraphs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return paragraphs.groupBy(F.col(id_col).alias("doc_id")).agg(F.count("*").cast("int").alias("para_count"))


def completeness(metadata: DataFrame) -> DataFrame:
    """(year, documents, complete) by year."""
    return metadata.groupBy("year").agg(F.count("*").alias("documents"), F.count_if("has_complete_metadata").alias("complete"))


def missing_by_field(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.explode("missing_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))
