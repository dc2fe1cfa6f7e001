"""Makes the package known to Python workers that cannot import it from a path of their own."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once per application (some 200 kB)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="gridloom-src-")
    archive = os.path.join(folder, "gridloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.join("gridloom", os.path.relpath(os.path.join(at, f), here)))
    spark.sparkContext.addPyFile(archive)
    # the driver serves this file to executors as long as the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _shipped.add(app)
