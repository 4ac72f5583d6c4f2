"""Sends the package to the executors, which need not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application, once; Spark's file server hands it out."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    made = shutil.make_archive(os.path.join(folder, home.name), "zip", home.parent, home.name)
    spark.sparkContext.addPyFile(made)
    _SENT.add(app)
