"""What Python workers need to run this package's functions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Lets workers on this machine import the package; on a cluster it is sent with the job."""
    own = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in own.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [own, ROOT]))
