"""A session with the settings that the engine is tuned for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application: they need not have it installed or share its folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="mosaicore-")) / "mosaicore-package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def session(app: str = "mosaicore", **conf: str) -> SparkSession:
    """The active session, or a new one; conf overrides (dots as double underscores)."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # rows of the image tables hold whole planes; small batches bound a worker's memory
        "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
