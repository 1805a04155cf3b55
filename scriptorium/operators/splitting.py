"""Splits by year, hard samples, and the repair of years and misplaced rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P


def split_of_year(year: Column) -> Column:
    """The split whose range of years holds the year, null outside all of them."""
    out = None
    for name, (lo, hi) in P.YEARS.items():
        hit = year.between(lo, hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def documents_by_split(metadata: DataFrame) -> DataFrame:
    """(doc_id, year, split) of documents with an id and a year inside a split."""
    d = metadata.where((F.col("year") > 0) & (F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "")).select("doc_id", "year").distinct()
    return d.withColumn("split", split_of_year(F.col("year"))).where("split IS NOT NULL")


def paragraphs_in_split(paragraphs: DataFrame, docs: DataFrame, split: str) -> DataFrame:
    """Paragraphs whose document is in the split."""
    return paragraphs.join(docs.where(F.col("split") == split).select("doc_id").distinct(), "doc_id", "left_semi")


def hardness(char_count: Column, citation: Column, formula: Column, role: Column, kind: Column) -> Column:
    def points(cond: Column, n: float) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(n)).otherwise(F.lit(0.0))

    return (
        points(char_count.between(50, 300), 2.0) + points(citation, 1.5) + points(formula, 1.0) + points(role.isin(*P.HARD_ROLES), 2.0) + points(kind == "normal", 1.0)
    )


def scored(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.withColumn("score", hardness(F.col("char_count"), F.col("has_citation"), F.col("has_formula"), F.col("chapter_role"), F.col("para_type")))


#: Rows to one bucket of order, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 64


def ranked(df: DataFrame, by: list[str], order: str, first: str | None = None, out: str = "rank", total: str | None = None) -> DataFrame:
    """The rank (from 1) of each row within its group by falling `first`, a column of few values, then by the number `order`; `total` is the group's size.

    No group is sorted as a whole: counts for each value and bucket of the order give a row's offset, and only rows of one value and bucket are sorted
    together. Buckets keep the order of the numbers, an equal-width grid between the least and the largest, and grow in number with the rows.
    """
    keys = [*by, *([first] if first else [])]
    d = lambda c: F.col(c).cast("double")
    lim = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.count("*") / F.lit(BUCKET_ROWS))).cast("double").alias("_n"))
    place = F.floor((d(order) - d("_lo")) * F.col("_n") / (d("_hi") - d("_lo") + 1.0)).cast("int")
    s = df.join(F.broadcast(lim)).withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(0)).drop("_lo", "_hi", "_n")  # one row
    counts = s.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(*([F.desc(first)] if first else []), "_b")  # at most values x buckets rows a group
    counts = counts.select(*keys, "_b", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), *([F.sum("_c").over(Window.partitionBy(*by)).alias(total)] if total else []))
    inner = Window.partitionBy(*keys, "_b").orderBy(order)
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_b")]
    r = s.withColumn("_rn", F.row_number().over(inner)).alias("s").join(counts.alias("c"), same)
    return r.select("s.*", *([f"c.{total}"] if total else []), (F.col("c._before") + F.col("s._rn")).alias(out)).drop("_b", "_rn")


def hard_samples(paragraphs: DataFrame, ratio: float = P.HARD_RATIO, by: str = "split", order: str = "row_id") -> DataFrame:
    """The input with `score` and `hard`: of each split the share of rows with the highest scores, then at most half of a document's candidates, first come first.

    `order` is a number that grows as the documents and their paragraphs come (runtime.numbered makes one).
    """
    r = ranked(scored(paragraphs), [by], order, "score", "_rank", "_total").withColumn("_candidate", F.col("_rank") <= F.floor(F.col("_total") * F.lit(ratio)))
    doc = Window.partitionBy(by, "doc_id", "_candidate")
    r = r.withColumn("_dn", F.row_number().over(doc.orderBy(F.desc("score"), order))).withColumn("_dc", F.count("*").over(doc))
    return r.withColumn("hard", F.col("_candidate") & ((F.col("_dn") - 1) < F.col("_dc") * 0.5)).drop("_rank", "_total", "_candidate", "_dn", "_dc")


def split_statistics(paragraphs: DataFrame) -> DataFrame:
    """Per split: documents and rows before, rows after and documents of hard rows; needs `hard`."""
    return paragraphs.groupBy("split").agg(
        F.countDistinct("doc_id").alias("docs"), F.count("*").alias("paras_before"), F.count_if(~F.col("hard")).alias("paras_standard"),
        F.count_if("hard").alias("paras_hard"), F.countDistinct(F.when(F.col("hard"), F.col("doc_id"))).alias("hard_docs"))


def split_index(docs: DataFrame) -> DataFrame:
    """(doc_id, split): a document found under several years has the latest split."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2)
    return docs.groupBy("doc_id").agg(F.max_by("split", order).alias("split"))


def hard_index(paragraphs: DataFrame) -> DataFrame:
    """Distinct (doc_id, split) of hard rows, the split under its hard name."""
    return paragraphs.where("hard").select("doc_id", F.concat("split", F.lit("_hard")).alias("split")).distinct()


def repaired_years(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Year 0 is replaced by the metadata's year, where that has one; `updated` tells so."""
    years = metadata.where("year > 0").groupBy("doc_id").agg(F.max("year").alias("meta_year"))
    d = rows.join(years, "doc_id", "left")
    fixed = F.when((F.col("year") == 0) & F.col("meta_year").isNotNull(), F.col("meta_year")).otherwise(F.col("year"))
    return d.withColumn("updated", (F.col("year") == 0) & F.col("meta_year").isNotNull()).withColumn("year", fixed).drop("meta_year")


def misplaced(rows: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows with the split of their year and whether they stand in another one."""
    t = split_of_year(F.col("year"))
    return rows.withColumn("target_split", t).withColumn("misplaced", F.coalesce(t != F.col(split_col), F.lit(False)))


def moved(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """All rows with the split they end up in: a misplaced row moves unless its document and the first 50 characters of its text are there already, or came before it."""
    m = misplaced(rows).withColumn("key", F.substring("original_text", 1, 50))
    there = m.where("NOT misplaced").select(F.col("split").alias("target_split"), "variant_type", "doc_id", "key").distinct()
    w = Window.partitionBy("target_split", "variant_type", "doc_id", "key").orderBy(order)
    go = m.where("misplaced").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    go = go.join(there, ["target_split", "variant_type", "doc_id", "key"], "left_anti")
    return m.where("NOT misplaced").withColumn("final_split", F.col("split")).unionByName(go.withColumn("final_split", F.col("target_split"))).drop("key")


def validation_errors(rows: DataFrame, fields: tuple[str, ...] = ("original_text", "variant_text", "variant_type", "doc_id", "year")) -> DataFrame:
    """(row_id, errors): the first missing field, and a year of 0."""
    first = F.coalesce(*(F.when(F.col(f).isNull(), F.lit(f"missing {f}")) for f in fields))
    errors = F.array_compact(F.array(first, F.when(F.coalesce(F.col("year"), F.lit(0)) == 0, "year=0")))
    return rows.select("row_id", errors.alias("errors")).where(F.size("errors") > 0)


def year_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "variant_type", "year").agg(F.count("*").alias("n"))
