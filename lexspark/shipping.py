"""Hands this package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on every executor, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(prefix="lexspark-"), "lexspark_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(top.rglob("*.py")):
                out.write(source, source.relative_to(top.parent))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark
