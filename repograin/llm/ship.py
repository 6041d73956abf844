"""Bring this package to the Python workers, wherever they run and whatever folder the driver was started in."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import repograin

_shipped: set[str] = set()  # applications that have it


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to Spark once per application; Spark serves them to every executor.

    The archive stays on the driver for the life of the process: Spark reads it whenever an executor starts.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(repograin.__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="repograin-sources-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "repograin.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, file.relative_to(home.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
