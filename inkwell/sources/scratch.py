"""A place for tables that are written and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir (or a temporary one where it is unset and all run on one machine); gone when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkwell-"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    out = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return out
