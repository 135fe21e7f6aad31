"""Readers of the stored tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers; a zip of it is only sent where its folder isn't on their path."""
    app = spark.sparkContext.applicationId
    home = str(_ROOT.parent)
    if app in _SHIPPED or home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == home:
        return
    folder = tempfile.mkdtemp(prefix="graphloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{_ROOT.name}", "zip", home, _ROOT.name))
    _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One stored table; column pruning and filters reach the Parquet scan."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
