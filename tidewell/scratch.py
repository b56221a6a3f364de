"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder (spark.checkpoint.dir, or the context's checkpoint folder).

    A temporary one is made only where none is set and all tasks run on this machine; on a cluster that raises an error.
    """
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
    return context._jsc.sc().getCheckpointDir().get()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application: call it once results are written, as results read from them."""
    discard(spark, own_dir(spark))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files of a step go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(frame: DataFrame, tag: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = frame.sparkSession
    path = scratch(spark, tag)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
