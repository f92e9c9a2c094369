"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quillstone")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    for key, value in (settings | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, once a context; a cluster need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_quillstone_shipped", False):
        package = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="quillstone-ship-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the archive until then
        try:
            copy = folder / "tree" / package.name
            shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
            archive = shutil.make_archive(str(folder / "quillstone_package"), "zip", folder / "tree")
            context.addPyFile(archive)
        finally:
            shutil.rmtree(folder / "tree", ignore_errors=True)
        context._quillstone_shipped = True
    return spark
