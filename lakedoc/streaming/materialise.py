"""Views kept as tables: each micro-batch of a log adds the rows that its documents emit now.

A batch writes one folder named by its number, so a batch that is run again writes the same rows. Of each id the rows of its
last sequence number count; a document that emits nothing any more, or is deleted, leaves a mark.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collection import Collection
from ..operators.views import View
from .changes import follow


def view_rows(view: View, events: DataFrame) -> DataFrame:
    """``id, k0.., value, seq, mark``: what each of the latest events emits, and a mark for each of them."""
    collection = replace(Collection(events), order=("_seq",))
    rows = view.rows(collection).join(events.select(F.col("_id").alias("id"), F.col("_seq").alias("seq")), "id").withColumn("mark", F.lit(False))
    return rows.unionByName(events.select(F.col("_id").alias("id"), F.col("_seq").alias("seq"), F.lit(True).alias("mark")), allowMissingColumns=True)


def maintain(view: View, log: DataFrame, path: str, checkpoint: str, *, available_now: bool = True):
    """Follow a log into the table of a view's rows; returns the streaming query."""
    return follow(log, lambda events, n: view_rows(view, events).write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint, available_now=available_now)


def maintained(spark: SparkSession, path: str) -> DataFrame:
    """The view's rows ``id, k0.., value`` as of the batches done; one aggregation of numbers and a join by id."""
    rows = spark.read.parquet(path).drop("batch")
    last = rows.where("mark").groupBy("id").agg(F.max("seq").alias("seq"))
    return rows.where("NOT mark").join(last, ["id", "seq"], "left_semi").drop("seq", "mark")
