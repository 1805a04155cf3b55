"""Streams of documents: quality control in micro-batches, and windowed counts with late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.quality_control import process


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch is cleaned and checked, then handed to the sink; the checkpoint makes a restart go on where it stopped."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(process(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, by: str, time: str = "ingested_at", window: str = "1 day", late: str = "14 days") -> DataFrame:
    """Rows and characters by window and value; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
