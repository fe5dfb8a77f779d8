"""The folder that driver and executors share, and intermediate folders in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


class SharedFolderError(RuntimeError):
    """The session names no folder that all its machines see."""


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Only a local session gets one of its own where both are unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise SharedFolderError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; what is written there is deleted when this process ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made[:] = [m for m in _made if m[1] != path]


@atexit.register
def _sweep() -> None:
    """Folders of sessions that still run; those of stopped ones have no file system to be reached through."""
    for spark, path in list(_made):
        try:
            if spark.sparkContext._jsc is not None:
                drop_folder(spark, path)
        except (Py4JError, OSError):  # the JVM has gone first
            return
