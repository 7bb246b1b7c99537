"""A Spark library for ranking, matching and auditing time-stamped candidates."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where it lies; on a cluster it is shipped with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
