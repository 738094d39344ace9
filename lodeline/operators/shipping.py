"""Sends this package to the executors, for functions that run there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; executors then needn't have the package on their path."""
    if (app := spark.sparkContext.applicationId) in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parents[2]
    file = Path(tempfile.mkdtemp(prefix="lodeline-"), "lodeline.zip")
    with zipfile.ZipFile(file, "w") as out:
        for p in sorted(root.joinpath("lodeline").rglob("*.py")):
            out.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(file))
