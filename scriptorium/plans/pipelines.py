"""The stages put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import metadata, quality_control, segmentation, splitting
from scriptorium.operators.detector import Detector
from scriptorium.operators.fusion import Fusion
from scriptorium.runtime import numbered


def split_rows(paragraphs: DataFrame, meta: DataFrame) -> DataFrame:
    """Paragraphs with the split of their document and row_id, a number in the order of documents and paragraphs."""
    docs = splitting.split_index(splitting.documents_by_split(meta))
    return numbered(paragraphs.join(docs, "doc_id"), "doc_id", "para_index")


def corpus(docs: DataFrame, hard_ratio: float | None = None) -> dict[str, DataFrame]:
    """docs (doc_id, path, text) to reports, paragraphs, metadata and split rows with their hard samples; what is read again and again is written once."""
    reports = quality_control.process(docs)
    cleaned = reports.select("doc_id", "path", F.col("cleaned").alias("text"))
    paras = segmentation.keep_lengths(segmentation.segment(cleaned.withColumn("year", metadata.year_of_path(F.col("path"))), extra=("year",)))
    meta = metadata.extract(cleaned, paras)
    rows = split_rows(paras, meta)
    hard = splitting.hard_samples(rows) if hard_ratio is None else splitting.hard_samples(rows, hard_ratio)
    return {"reports": reports, "paragraphs": paras, "metadata": meta, "rows": hard}


def detect(docs: DataFrame, specs: dict[str, dict], mode: str = "calibrated", dim: int = 64, encoder=None) -> DataFrame:
    """docs (doc_id, text) to scored documents: paragraphs, online vectors, five trees, fusion, roll-up. One exchange, by document."""
    bundle = {m: s if "tree" in s else {"tree": s} for m, s in specs.items()}
    return Detector(bundle, Fusion(mode), mode == "calibrated", encoder, dim).detect(docs)
