"""Folders that the driver and all executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, prefix: str, base: str | None = None) -> str:
    """A new folder's path below `base`, or else below spark.checkpoint.dir, or else below the context's checkpoint folder.

    Where a session names none of them, a local one gets a temporary folder; a cluster's executors could not see it, so there it
    is an error.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexicask-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
