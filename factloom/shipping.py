"""Makes this package importable on executors that do not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the session's executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="factloom-code-")
    archive = shutil.make_archive(f"{folder}/factloom", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
