"""Makes this package importable on executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package to the session's executors, once per application, as compiled modules in one archive."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    to = Path(tempfile.mkdtemp(prefix="rankmill-")) / "rankmill_package.zip"  # read by the driver, which serves it
    with zipfile.PyZipFile(to, "w") as z:
        z.writepy(str(Path(__file__).resolve().parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)
