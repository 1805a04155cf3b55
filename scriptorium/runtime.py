"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
LOCAL = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}


def session(name: str = "scriptorium", cores: str = "*", **conf: str) -> SparkSession:
    """The session there is, or that of the cluster this was submitted to; else a local one with the settings the library is tested under.

    A cluster brings its own master, memory and partitions; only what it leaves unset is set.
    """
    have = SparkSession.getActiveSession()
    if have is not None:
        return have
    b = SparkSession.builder.appName(name)
    given: dict[str, str] = {}
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # under spark-submit
        SparkContext._ensure_initialized()
        given = dict(SparkConf().getAll())
    if "spark.master" not in given:
        b = b.master(f"local[{cores}]")
        conf = {**LOCAL, **conf}
    for k, v in {**DEFAULTS, **conf}.items():
        if k not in given:
            b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a context, so that they need no path to it of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_scriptorium_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="scriptorium-")) / "scriptorium_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._scriptorium_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster in spark.checkpoint.dir; a temporary one only in local mode, where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    have = getattr(sc, "_scriptorium_dir", None)
    if have is None:
        folder = tempfile.mkdtemp(prefix="scriptorium-")
        atexit.register(shutil.rmtree, folder, True)
        have = sc._scriptorium_dir = f"file://{folder}"
    return have


def cut(df: DataFrame, label: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scriptorium/{label}-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    sc = spark.sparkContext
    sc._scriptorium_cuts = [*getattr(sc, "_scriptorium_cuts", []), path]
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; frames made of them can't be read any more."""
    sc = spark.sparkContext
    for path in getattr(sc, "_scriptorium_cuts", []):
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    sc._scriptorium_cuts = []


def drop(df: DataFrame) -> None:
    """Delete a table that `cut` has written, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    files = df.inputFiles()
    for path in [*getattr(sc, "_scriptorium_cuts", [])]:
        if any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in files):
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            sc._scriptorium_cuts.remove(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are deleted when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def numbered(df: DataFrame, *order: str, out: str = "row_id") -> DataFrame:
    """The rows with a number that grows in the given order; ranges are sorted each by itself, never all rows in one task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.withColumn(out, F.monotonically_increasing_id()), "numbered")
