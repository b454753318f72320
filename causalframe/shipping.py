"""The package on executors: functions that run there may name its classes."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, unless they are set up to
    find it themselves (PYTHONPATH, or an installed package)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "site-packages" in root or context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="causalframe-"), "causalframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "causalframe")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
