"""Cutting lineage: tables in the session's shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster, whose
    executors would each write to a disk of their own, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def staged(df: DataFrame, name: str = "step", compression: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder, with the session's compression unless another is given, and reads it again.

    A lost executor then costs a read, not a recomputation, and joins see the true size of the table,
    so that Spark broadcasts it only if it is below the session's threshold.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def reclaim(spark: SparkSession) -> None:
    """Has the driver collect garbage: Spark deletes the shuffle files of plans that are done when it finds them unused,
    which on a driver with room to spare would be long after the tables that they led to are written."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is queried in here deletes its shuffle files as soon as its result is there; the driver needn't collect garbage first,
    which often finds the last query's plan still in use."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing unwritten is read from any more, and the shuffles that are done with."""
    for df in tables:
        path = getattr(df, "_staged", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        reclaim(tables[0].sparkSession)
