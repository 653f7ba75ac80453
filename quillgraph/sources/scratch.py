"""The folder all machines share, and temporary tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set a local session gets a temporary folder; on a cluster, whose machines could not
    read each other's, that is an error.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def folder(spark: SparkSession, path: str):
    """A path and the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_path(spark: SparkSession, name: str) -> str:
    """A new, empty folder in the shared one; what is written there goes when the driver's JVM ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target, files = folder(spark, path)
    files.mkdirs(target)  # a path must exist to be marked
    files.deleteOnExit(target)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        target, files = folder(spark, path)
        files.delete(target, True)
