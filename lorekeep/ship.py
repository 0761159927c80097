"""Makes this package importable in the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's modules to the executors, once in each application."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    top = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(to)
    _DONE.add(sc.applicationId)
