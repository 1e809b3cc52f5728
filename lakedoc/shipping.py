"""Makes this package importable in Spark's Python workers, wherever the driver found it."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application; Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as staged:
        shutil.copytree(package, Path(staged, package.name), ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="lakedoc-"), package.name)), "zip", staged)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shipped(query: Callable) -> Callable:
    """``query``, whose first argument is the session, with the package shipped first."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **options):
        ship(spark)
        return query(spark, *args, **options)

    return run
