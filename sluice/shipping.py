"""Makes the package importable in Python workers that don't have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application; workers on this machine that have it on their PYTHONPATH need nothing."""
    app = spark.sparkContext.applicationId
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _shipped or (str(ROOT) in paths and spark.sparkContext.master.startswith("local")):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "sluice"), "zip", ROOT, "sluice")
    spark.sparkContext.addPyFile(made)
    _shipped.add(app)
