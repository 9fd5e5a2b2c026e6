"""Makes this package importable by Python workers that don't share the driver's module path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once a session."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quern-src-")
    path = os.path.join(folder, "quern.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(path)
    context._quern_shipped = True
