"""Sending the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each Spark context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_sievework_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sievework-")), f"{root.name}-package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(to)
    sc._sievework_shipped = True
