"""Makes the package importable on every executor of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources through Spark's own file server, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="stratalith-")) / "stratalith-src.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, str(source.relative_to(root.parent)))
        context.addPyFile(str(target))
        _shipped[context.applicationId] = str(target)
    return spark
