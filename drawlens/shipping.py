"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import io
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once per Spark context."""
    context = spark.sparkContext
    if context not in _shipped:
        root = Path(__file__).parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        path = Path(tempfile.mkdtemp(prefix="drawlens-")) / "drawlens.zip"
        path.write_bytes(data.getvalue())
        context.addPyFile(str(path.resolve()))
        _shipped.add(context)
    return spark
