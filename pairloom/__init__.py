"""pairloom: pair-trial construction, sampling and scoring on Spark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this file system import the package from where the driver has it.
    On a cluster without a shared file system, submit with --py-files instead."""
    home = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known]))
    return spark
