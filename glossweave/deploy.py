"""Getting this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SENT: set[str] = set()


def reachable() -> bool:
    """Whether Python processes started from here find the package by themselves."""
    folders = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(f and Path(f).resolve() == ROOT for f in folders)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, unless they find it by themselves."""
    app = spark.sparkContext.applicationId
    if app in _SENT or reachable():
        return
    folder = tempfile.mkdtemp(prefix="glossweave-")  # on the driver, which serves it as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{Path(__file__).parent.name}", "zip", ROOT, Path(__file__).parent.name))
    _SENT.add(app)
