"""Queries of the operators for training text, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import encoding, language, mixing, names, overlap, pairs, quality, scans, splits, tokens
from scriptorium.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.found(table(spark, d, "documents_metadata"), table(spark, d, "variants"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(table(spark, d, "documents_metadata"), table(spark, d, "variants"), table(spark, d, "split_targets"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.report(p1_splits(spark, d), table(spark, d, "split_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.judge(table(spark, d, "variants")).select("row_id", "defect")


def p6_defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.judge(table(spark, d, "variants"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(table(spark, d, "paragraphs")).select("row_id")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(table(spark, d, "paragraphs"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(table(spark, d, "paragraphs"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return scans.restore(table(spark, d, "paragraphs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "paragraphs"), table(spark, d, "variants"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "paragraphs"), table(spark, d, "variants"))


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "documents_metadata"), table(spark, d, "name_registry"), table(spark, d, "char_readings")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(*_names(spark, d))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.linked(*_names(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "paragraphs")).select("row_id", "kind")


def p5_outliers(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "paragraphs"))


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "paragraphs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "documents"))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.detect(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares,
    "p2_found": p2_found, "p2_restored": p2_restored,
    "p3_found": p3_found, "p3_report": p3_report,
    "p4_found": p4_found, "p4_entities": p4_entities,
    "p5_found": p5_found, "p5_outliers": p5_outliers, "p5_statistics": p5_statistics,
    "p6_found": p6_found, "p6_defects": p6_defects,
    "p7_found": p7_found, "p7_restored": p7_restored,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_languages": p10_languages,
}

_WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NOBODY = ", ".join(f"'{p}'" for p in splits.PLACEHOLDERS)
SQL: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE m AS (SELECT DISTINCT doc_id, paper_hash, author, school FROM documents_metadata WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, 'h' || paper_hash AS k FROM m WHERE regexp_replace(paper_hash, '{_WS}', '', 'g') <> '' AND paper_hash <> '{splits.EMPTY_HASH}'
 UNION SELECT doc_id, 'n' || author || chr(10) || school FROM m WHERE regexp_replace(author, '{_WS}', '', 'g') <> '' AND regexp_replace(school, '{_WS}', '', 'g') <> '' AND lower(regexp_replace(author, '^{_WS}|{_WS}$', '', 'g')) NOT IN ({_NOBODY})),
e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b USING (k)),
reach(v, r) AS (SELECT DISTINCT doc_id, doc_id FROM m UNION SELECT reach.v, e.b FROM reach JOIN e ON reach.r = e.a),
g AS (SELECT v, min(r) AS g FROM reach GROUP BY v),
w AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(doc_id, '{_WS}', '', 'g')), '^.*/', ''), '\\.[a-z]{{1,4}}$', '') AS b FROM variants WHERE doc_id IS NOT NULL),
c AS (SELECT doc_id, coalesce(nullif(regexp_extract(b, '(?:^|_)(d[0-9]{{10}})(?:_[0-9]+)?$', 1), ''), b) AS c FROM w)
SELECT v AS doc_id, g AS group_doc_id FROM g WHERE v <> g UNION SELECT c.doc_id, g.g FROM c JOIN g ON c.c = g.v WHERE c.doc_id <> g.g""",
}
