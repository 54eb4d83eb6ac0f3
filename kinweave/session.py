"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application: they may have neither the driver's folders nor its path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="kinweave-")) / "kinweave_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path(top.name) / p.relative_to(top))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
