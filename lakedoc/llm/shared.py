"""Places that every executor can reach, and cutting of lineage into them.

What is written there lies below one folder per application. Operators delete a table as soon as nothing can read
it any more; tables behind a lazy result stay until its reader calls ``discard_all``, or the cluster clears the folder.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process, by application, where the setting is unset.
_unset: dict[str, str] = {}
#: Tables written by this process and not deleted yet, by application, oldest first.
_written: dict[str, list[str]] = {}
_path_of: WeakKeyDictionary = WeakKeyDictionary()
#: Spark deletes the shuffle files of a finished query under this setting, instead of when the driver's JVM collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a fresh local one only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        app = spark.sparkContext.applicationId
        if app not in _unset:
            _unset[app] = "file://" + tempfile.mkdtemp(prefix="lakedoc-")
        root = _unset[app]
    return root


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/lakedoc-{app}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes a query's shuffle files when the query ends. The session's own setting returns afterwards."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and continue from that copy, which outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """``spill`` for rows of no particular name."""
    return spill(df, "cut")


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    kept = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        where = hadoop(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in kept:
            kept.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``spill`` returned and that no later query reads."""
    for df in tables:
        if (path := _path_of.pop(df, None)) is not None:
            _delete(df.sparkSession, [path])


def mark(spark: SparkSession) -> int:
    """How many tables stand now, for ``discard_all``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def discard_all(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete all tables written since ``mark``, but for ``keep``; lazy results that read them are void."""
    spared = _path_of.get(keep) if keep is not None else None
    _delete(spark, [p for p in _written.get(spark.sparkContext.applicationId, [])[since:] if p != spared])
