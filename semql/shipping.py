"""The package for workers whose path doesn't hold it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        made = Path(tempfile.mkdtemp(prefix="semql-"))
        shutil.copytree(Path(__file__).resolve().parent, made / "in" / "semql", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(made / f"semql-{app}"), "zip", made / "in"))
        _SHIPPED.add(app)
