"""Makes the package importable where Python workers run."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application.

    Python functions that run in workers are pickled by reference to this package; a driver that merely has it on its
    path would otherwise fail on other machines.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ledgerloom-src-")
    target = Path(folder, "src", root.name)
    shutil.copytree(root, target, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    archive = shutil.make_archive(os.path.join(folder, root.name), "zip", target.parent)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
