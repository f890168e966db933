"""Gives the executors' Python workers this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def deployed(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once per application.

    Functions that run there refer to its modules. Spark serves the archive
    from the driver, so nothing is expected to be installed on the machines.
    """
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        package = Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(prefix=f"{package.name}-"), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(archive)
        _SENT.add(context.applicationId)
    return spark
