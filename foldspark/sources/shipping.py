"""Sends this package to the executors, so that their Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_foldspark_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "foldspark.zip")  # the driver's own; Spark serves it to the executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("foldspark", os.path.relpath(full, PACKAGE)))
    context.addPyFile(path)
    context._foldspark_shipped = True
