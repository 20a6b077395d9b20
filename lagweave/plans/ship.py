"""Makes the package importable on executors, which share neither folders nor a Python path with the driver."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import lagweave

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's modules to the workers, once for each Spark application. Operators that run Python call it."""
    app = spark.sparkContext.applicationId
    root = Path(lagweave.__file__).parent
    if app not in _SHIPPED and root.is_dir():
        path = Path(tempfile.mkdtemp(prefix="ship")) / "lagweave_modules.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark
