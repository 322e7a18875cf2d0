"""How the package reaches the executors: kernels are imported by Python workers, which may not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the application's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tessera-")), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(top.rglob("*")):
            if f.is_file() and "__pycache__" not in f.parts:
                out.write(f, Path(top.name) / f.relative_to(top))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
