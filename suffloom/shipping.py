"""Makes this package importable on executors that don't have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the session as a zip file, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_suffloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, "suffloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._suffloom_shipped = True
