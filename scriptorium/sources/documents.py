"""Readers of documents, of stage outputs and of model bundles."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import newlines
from scriptorium.operators.metadata import stem, year_of_parent

PARAGRAPH = "text string, doc_id string, year int, chapter string, para_index int, para_type string, chapter_role string, char_count int, word_count int, sentence_count int, has_citation boolean, has_formula boolean, has_table_ref boolean, has_figure_ref boolean"
VARIANT = "original_text string, variant_text string, variant_type string, doc_id string, year int, para_type string, chapter_role string, _corrupt_record string"
METADATA = "doc_id string, paper_hash string, source_doc_id string, year int, title string, school string, major string, author string, char_count int, para_count int, chapter_count int, source_path string, relative_path string, has_complete_metadata boolean, missing_fields array<string>"


def read_text(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, text): whole files in UTF-8 with universal line ends, folders searched to any depth; bytes that are no UTF-8 are left out.

    Only files that hold such bytes pass through Python.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    d = (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "content")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"path": pdf["path"], "value": [bytes(c).decode("utf-8", "ignore") for c in pdf["content"]]})

    valid = F.is_valid_utf8(F.col("content").cast("string"))
    good = d.where(valid).select("path", F.col("content").cast("string").alias("value"))
    bad = d.where(~valid).mapInPandas(run, "path string, value string")
    return good.unionByName(bad).select("path", newlines(F.col("value")).alias("text"))


def decoded(uri: Column) -> Column:
    """A file's path as it is written, not as a URI escapes it."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, year, text) of Markdown files; reports among them are left out."""
    d = read_text(spark, path, "*.md")
    d = d.where(~file_name(F.col("path")).contains("S1.5") & ~file_name(F.col("path")).contains("qc_"))
    return d.select("path", stem(F.col("path")).alias("doc_id"), year_of_parent(F.col("path")).alias("year"), "text")


def markdown_with_paragraphs(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Documents that have paragraphs."""
    return docs.join(paragraphs.select("doc_id").distinct(), "doc_id", "left_semi")


def docx_text(data: bytes) -> str:
    """Paragraphs of a word processor file, tags stripped; what is no such file gives an empty text."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "ignore")
    except (zipfile.BadZipFile, KeyError, OSError):
        return ""
    return re.sub("<[^>]+>", "", xml.replace("</w:p>", "\n"))


def pdf_text(data: bytes) -> str:
    """Page texts of a PDF joined by line feeds; needs the optional parser."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pypdf") from e
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of PDF and word processor files, parsed in the workers."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"path": pdf["path"], "text": [pdf_text(c) if p.lower().endswith(".pdf") else docx_text(c) for p, c in zip(pdf["path"], pdf["content"])]})

    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return b.where(suffix(F.col("path")).isin("pdf", "docx")).mapInPandas(run, "path string, text string")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Any folder of documents, each by its suffix; another suffix is an error when its row is read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    known = suffix(F.col("path")).isin("txt", "md", "pdf", "docx")
    other = listing.where(~known).select("path", F.raise_error(F.concat(F.lit("no reader for "), F.col("path"))).cast("string").alias("text"))
    return read_text(spark, path, "*.{txt,md,TXT,MD}").unionByName(read_binary(spark, path)).unionByName(other)


def read_json_array(spark: SparkSession, path: str, schema: str = PARAGRAPH) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_envelope(spark: SparkSession, path: str, field: str = "metadata", schema: str = METADATA) -> DataFrame:
    """Rows of an array inside one object; none where it is missing."""
    return spark.read.schema(f"{field} array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>").option("multiLine", True).json(path).select(F.inline(F.coalesce(field, F.array())))


def readable() -> Column:
    """Rows of files that are JSON; the text is looked at too, for the column of what could not be read may not be asked for alone."""
    return F.coalesce(F.length("_corrupt_record"), F.lit(0)) + F.coalesce(F.length("original_text") * 0, F.lit(0)) == 0


def read_variant_files(spark: SparkSession, path: str) -> DataFrame:
    """Variants of files named {split}_{type}_variants.json, type and split from the name; files that are no JSON give no rows."""
    d = spark.read.schema(VARIANT).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*_variants.json").json(path)
    name = stem(decoded(F.col("_metadata.file_path")))
    d = d.withColumn("split", F.regexp_extract(name, "^([^_]+)_(.+)_variants$", 1)).withColumn("file_type", F.regexp_extract(name, "^([^_]+)_(.+)_variants$", 2))
    return d.where(readable()).drop("_corrupt_record")


def read_existing(spark: SparkSession, path: str) -> DataFrame:
    """The variants saved so far, a table or a file holding a JSON array; none where it is missing or can't be read."""
    empty = spark.createDataFrame([], VARIANT.replace(", _corrupt_record string", ""))
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return empty
    try:
        if path.endswith(".json"):
            d = spark.read.schema(VARIANT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
            return d.where(readable()).drop("_corrupt_record")
        return spark.read.parquet(path)
    except AnalysisException:  # no such table
        return empty


#: Columns of a feature row in any of its three layouts.
FEATURES = "features array<struct<combined_features:array<double>,bert_features:array<double>,stat_features:array<double>,char_count:double,sentence_count:double,chinese_ratio:double,comma_count:double,period_count:double,vocab_diversity:double,label:int,difficulty_level:string,generation_path:string>>"
LOOSE = ("char_count", "sentence_count", "chinese_ratio", "comma_count", "period_count", "vocab_diversity")


def feature_vector(combined: Column, embedding: Column, stat: Column, loose: list[Column]) -> Column:
    """The vector of a feature row in whichever of three layouts it came: combined, two parts, or embedding with six loose numbers."""
    return F.coalesce(combined, F.concat(embedding, stat), F.concat(embedding, F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in loose))))


def feature_rows(df: DataFrame) -> DataFrame:
    """(features, label, split, difficulty_level, generation_path) of feature rows in any layout: what training and evaluation read."""
    has = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
    x = feature_vector(has("combined_features", "array<double>"), has("bert_features", "array<double>"), has("stat_features", "array<double>"), [has(c, "double") for c in LOOSE])
    return df.select(
        x.alias("features"), F.coalesce(has("label", "int"), F.lit(0)).alias("label"), has("split", "string").alias("split"),
        F.coalesce(has("difficulty_level", "string"), F.lit("standard")).alias("difficulty_level"), F.coalesce(has("generation_path", "string"), F.lit("human")).alias("generation_path"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows of a table with a partition a split, or of files {split}_features.json that hold an object with an array of them."""
    if path.endswith(".json") or "*" in path:
        d = spark.read.schema(FEATURES).option("multiLine", True).json(path)
        name = stem(decoded(F.col("_metadata.file_path")))
        d = d.withColumn("split", F.regexp_extract(name, "^(.+)_features$", 1)).select("split", F.inline(F.coalesce("features", F.array().cast(FEATURES.split(" ", 1)[1]))))
        return feature_rows(d)
    return feature_rows(spark.read.parquet(path))


def read_split_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, split) of a saved index."""
    d = spark.read.schema("doc_to_split map<string,string>").option("multiLine", True).json(path)
    return d.select(F.explode("doc_to_split").alias("doc_id", "split"))
