"""Intermediate tables of iterative jobs: written to the folder that driver and executors share, so that lineage ends there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may lack that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting to delete the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries run meanwhile delete their shuffle files when they end; a cached frame that is evicted makes its own anew."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The frame as read from its files, which ``discard`` deletes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomtab-{spark.sparkContext.applicationId}/step-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a ``written`` frame that nothing reads any more; other frames are left alone."""
    if path := getattr(df, "written_path", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
