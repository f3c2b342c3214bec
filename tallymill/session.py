"""Shared folder for checkpoints and written tables, and a local session for tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Folders this process has made, by Spark application; `release` deletes them.
_MADE: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
# Whether a query's shuffle files go when it ends, else when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallymill")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallymill-checkpoint-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, on any master. Where it is unset, a
    folder in the warehouse, which all executors share too."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared one, which `release` deletes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext, []).append(path)
    return path


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Queries that start here delete their shuffle files when they end. For results that are
    written down, since nothing reads these files again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder."""
    shared_folder(df.sparkSession)
    with without_leftovers(df.sparkSession):
        # As a new query, since the setting is read when a query is made.
        return df.select("*").checkpoint()


def stored(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: a narrow plan that
    survives lost executors, smaller than a checkpoint and with pushdown."""
    path = new_folder(df.sparkSession, name)
    with without_leftovers(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all checkpoints and tables this application has written to the shared
    folder. Results that still read them can't be used afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [*_MADE.pop(spark.sparkContext, []), shared_folder(spark)]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(conf)
        files.delete(folder, True)
    files.mkdirs(folder)
