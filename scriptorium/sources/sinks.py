"""Writers of stage outputs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_cleaned(df: DataFrame, path: str, root: str | None = None) -> None:
    """Cleaned documents by year, each with its path under the root it was read from; `export_cleaned` gives files again."""
    rel = relative_path(F.col("path"), root)
    write_table(df.select("doc_id", "year", "path", rel.alias("relative_path"), "cleaned", "fixes_applied"), path, ("year",))


def relative_path(path: Column, root: str | None) -> Column:
    """A path as it stands under a root: its last two parts where no root is known."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    if root is None:
        return F.regexp_extract(plain, "([^/]+/[^/]+)$", 1)
    base = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(F.regexp_extract(plain, "([^/]+)$", 1))


def export_cleaned(df: DataFrame, folder: str) -> int:
    """Write each cleaned document (relative_path, cleaned) as a file under the same relative path, in the workers; the folder is one all of them share."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for rel, text in zip(pdf["relative_path"], pdf["cleaned"]):
                p = Path(folder) / rel
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_text(text or "", encoding="utf-8")
            yield pd.DataFrame({"n": [len(pdf)]})

    return df.select("relative_path", "cleaned").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def report_rows(reports: DataFrame) -> DataFrame:
    """Quality reports as they are published: ratios to four places."""
    return reports.select("doc_id", *([c for c in ("relative_path",) if c in reports.columns]), "status", "char_count", F.round("chinese_ratio", 4).alias("chinese_ratio"), F.round("garbled_ratio", 4).alias("garbled_ratio"), "has_chapter_structure", "has_valid_ending", "issues", "fixes_applied", "needs_model_fix")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metadata(meta: DataFrame, path: str) -> None:
    """Metadata, its key mapping and its statistics."""
    from scriptorium.operators.metadata import completeness

    write_table(meta, f"{path}/metadata")
    write_table(key_mapping(meta), f"{path}/keys")
    write_table(completeness(meta), f"{path}/statistics")


def key_mapping(meta: DataFrame) -> DataFrame:
    return meta.select("paper_hash", "source_doc_id", "doc_id", "year", "has_complete_metadata")


def write_splits(rows: DataFrame, path: str) -> None:
    """One table, a partition a split, hard rows under the hard name of their split; in hidden folders beside the partitions statistics, the index of documents and that of hard documents."""
    from scriptorium.operators import splitting

    name = F.when(F.col("hard") & (F.col("split") != "train"), F.concat("split", F.lit("_hard"))).otherwise(F.col("split"))
    write_table(rows.withColumn("split", name), path, ("split",))
    if "doc_id" not in rows.columns:
        return
    write_table(splitting.split_statistics(rows), f"{path}/_statistics")
    write_table(rows.select("doc_id", "split").distinct(), f"{path}/_split_index")
    write_table(splitting.hard_index(rows.where("split <> 'train'")), f"{path}/_hard_docs")


#: Rows after which a run of variants is saved.
CHECKPOINT_EVERY = 10


def write_variants(df: DataFrame, path: str) -> None:
    """Finished variants are appended, whole batches at a time; a later run adds to them, `latest_variants` keeps one row of each."""
    write_table(df, path, ("split", "variant_type"), mode="append")


def run_variants(jobs: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str, batch: int = CHECKPOINT_EVERY, order: str = "row_id") -> int:
    """Answer jobs batch by batch for each task, so that what ended is kept when a run is broken off; jobs already saved are not asked again. The number of batches."""
    from scriptorium.sources.documents import read_existing

    done = read_existing(jobs.sparkSession, path)
    if order in done.columns:
        jobs = jobs.join(done.where("ok").select(order).distinct(), order, "left_anti")
    per = max(1, jobs.sparkSession.sparkContext.defaultParallelism) * batch
    n, lo = -(-jobs.count() // per), None
    for i in range(n):  # a batch of jobs for every core
        part = jobs if lo is None else jobs.where(F.col(order) > lo)
        part = part.orderBy(order).limit(per)
        lo = part.agg(F.max(order)).first()[0]
        write_variants(generate(part), path)
    return n


def latest_variants(df: DataFrame, order: str = "row_id") -> DataFrame:
    """One row for each document, paragraph, split and type: the first answered one."""
    w = Window.partitionBy("doc_id", "original_text", "split", "variant_type").orderBy(F.desc("ok"), order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def write_features(df: DataFrame, path: str) -> None:
    """Feature rows, a partition a split."""
    write_table(df, path, ("split",))


def write_evaluation(results: DataFrame, risks: DataFrame, path: str) -> None:
    """evaluation_results with the time of the run, risks of overfitting, and a summary to read; a row a model and split."""
    from scriptorium.operators.evaluation import summary_text

    write_json(results.withColumn("timestamp", F.current_timestamp()).coalesce(1), f"{path}/evaluation_results")
    write_json(risks.coalesce(1), f"{path}/overfitting")
    rows = results.where("error IS NULL").select("model", "split", summary_text().alias("t")).orderBy("model", "split")
    head = F.concat_ws("\n", F.concat(F.lit("模型: "), F.col("model")), F.lit("-" * 40), F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("split", "t"))), lambda x: x["t"])))
    rows.groupBy("model").agg(head.alias("value")).orderBy("model").coalesce(1).select("value").write.mode("overwrite").text(f"{path}/evaluation_summary")


def detection_json(scores: DataFrame, lists: DataFrame, first: int = 20) -> DataFrame:
    """(doc_id, json): a document's result with its first paragraphs."""
    d = scores.join(lists, "doc_id", "left").withColumn("paragraphs", F.slice(F.coalesce("paragraphs", F.array()), 1, first))
    return d.select("doc_id", F.to_json(F.struct(*[c for c in d.columns])).alias("json"))
