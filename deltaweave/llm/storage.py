"""Cutting lineage on shared storage."""

from __future__ import annotations

import contextlib
import gc
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def use_checkpoints(spark: SparkSession) -> None:
    """Take the folder of ``spark.checkpoint.dir``. Where it is unset, a local run takes a
    temporary folder of this machine, and a cluster's run fails: executors do not share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def delete_quietly(spark: SparkSession, folder: str) -> None:
    """The same at the driver's end, when the session may be gone."""
    with contextlib.suppress(Exception):
        delete(spark, folder)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows from the shared folder: computed once, and safe from lost executors."""
    use_checkpoints(frame.sparkSession)
    return frame.checkpoint(eager=True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Within, Arrow batches have at most so many rows: for rows with long lists, of which the
    default's ten thousand take much memory on both sides. Jobs must be run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
