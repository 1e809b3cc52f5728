"""Replication between revision tables: what the target lacks is merged into its leaves.

One-shot replication is an anti-join and a union. A continuous one appends the missing leaves of each micro-batch
to the target's log, in a folder named by job and batch, so a batch that is run again writes the same rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.revisions import lacking, leaves_of, merge_revisions


def replicate(source: DataFrame, target: DataFrame, *, since: int = 0, filters: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """The target's leaves after all leaves of ``source`` that changed after ``since`` and pass the filters."""
    return merge_revisions(target, to_send(source, target, since=since, filters=filters))


def to_send(source: DataFrame, target: DataFrame, *, since: int = 0, filters: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    rows = source.where(F.col("_seq") > since) if since and "_seq" in source.columns else source
    for f in filters:
        rows = f(rows)
    return lacking(rows, target).select(*source.columns)


def replication_id(source: str, target: str, **options) -> str:
    """The name under which both sides keep their checkpoints: equal jobs have equal names."""
    return hashlib.sha256(json.dumps([source, target, options], sort_keys=True).encode()).hexdigest()


def common_checkpoint(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``since``: the last sequence of the newest session that both histories (session_id, last_seq, at) hold, else 0."""
    both = ours.join(theirs.select("session_id"), "session_id", "left_semi")
    return both.agg(F.coalesce(F.max_by("last_seq", "at"), F.lit(0).cast("long")).alias("since"))


def replicate_stream(log: DataFrame, target_path: str, checkpoint: str, *, filters: Sequence[Callable[[DataFrame], DataFrame]] = (), available_now: bool = True):
    """Follow a log of revisions into the table at ``target_path``; ``read_target`` gives its leaves."""
    schema, job = log.schema, replication_id(checkpoint, target_path)[:16]

    def deliver(batch: DataFrame, number: int) -> None:
        rows = batch
        for f in filters:
            rows = f(rows)
        own = (F.col("_job") == job) & (F.col("_batch") == number)  # what an earlier try of this batch wrote does not count
        held = _held(batch.sparkSession, target_path, schema).where(~own).select(*schema.fieldNames())
        to_send(rows, held).write.mode("overwrite").parquet(f"{target_path}/_job={job}/_batch={number}")

    writer = log.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _held(spark: SparkSession, target_path: str, schema: StructType) -> DataFrame:
    whole = StructType([*schema.fields, StructField("_job", StringType()), StructField("_batch", LongType())])
    try:
        return spark.read.schema(whole).option("basePath", target_path).parquet(f"{target_path}/_job=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def read_target(spark: SparkSession, target_path: str, schema: StructType) -> DataFrame:
    """Leaves of all that was replicated there."""
    return leaves_of(_held(spark, target_path, schema).select(*schema.fieldNames()))
