"""Changes feeds: the latest event of each document, in batch and as a stream.

A log has ``_seq``, ``_id``, ``_rev``, ``_deleted`` and the document's columns. A feed holds each id once, at its last sequence
number; filters come before order and limit, and ``since`` is exclusive.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import Fields
from ..functions.selector import matches

DEFAULT_LIMIT = 1000
BROADCAST_ROWS = 10_000  # pages of more rows are joined as Spark sees fit


def latest(log: DataFrame) -> DataFrame:
    """The last event of each id, by partial aggregation; on a stream, the state of a running feed."""
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    return log.groupBy("_id").agg(F.max_by(row, F.col("_seq")).alias("e")).select("e.*")


def by_ids(ids: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.where(F.col("_id").isin(list(ids)))


def by_id_table(ids: DataFrame, id_col: str = "id") -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.join(ids.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")


def by_selector(selector: dict, body: str | None = None) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.where(matches(selector, Fields(rows, body)))


def design_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_id").startswith("_design/"))


def by_condition(condition: Column | Callable[[DataFrame], Column]) -> Callable[[DataFrame], DataFrame]:
    """A view's or a custom filter's condition: a document passes where it is true."""
    return lambda rows: rows.where(condition(rows) if callable(condition) and not isinstance(condition, Column) else condition)


@dataclass
class Feed:
    """A batch feed over a log. ``leaves``: with them, ``changes`` lists all leaf revisions."""

    log: DataFrame
    filters: Sequence[Callable[[DataFrame], DataFrame]] = ()
    leaves: DataFrame | None = None

    def events(self, since: int | str = 0) -> DataFrame:
        """``since``: a sequence number, or ``now`` for what comes after the log's end, which is nothing yet."""
        rows = latest(self.log.where(F.lit(False) if since == "now" else F.col("_seq") > since))
        for f in self.filters:
            rows = f(rows)
        return rows

    def changes(self, *, since: int | str = 0, limit: int | None = DEFAULT_LIMIT, descending: bool = False, include_docs: bool = False) -> DataFrame:
        order = F.desc("_seq") if descending else F.asc("_seq")
        if limit is not None and not self.filters and since != "now":
            # only ids and numbers are aggregated; the page's rows are fetched by number, and it has at most ``limit`` of them
            log = self.log.where(F.col("_seq") > since)
            page = log.groupBy("_id").agg(F.max("_seq").alias("_seq")).orderBy(order).limit(limit)
            rows = log.join(F.broadcast(page) if limit <= BROADCAST_ROWS else page, ["_id", "_seq"], "left_semi")
        else:
            rows = self.events(since)
        if limit is not None:
            rows = rows.orderBy(order).limit(limit)
        revs = F.array(F.col("_rev"))
        if self.leaves is not None:
            every = self.leaves.groupBy("_id").agg(F.sort_array(F.collect_set("_rev"), asc=False).alias("_revs"))
            rows, revs = rows.join(every, "_id", "left"), F.coalesce("_revs", revs)
        gone = F.coalesce("_deleted", F.lit(False)) if "_deleted" in rows.columns else F.lit(False)
        doc = [F.struct(*[F.col(f"`{c}`") for c in self.log.columns]).alias("doc")] if include_docs else []
        return rows.select(F.col("_seq").alias("seq"), F.col("_id").alias("id"), revs.alias("changes"), gone.alias("deleted"), *doc)

    def pending(self, *, since: int | str = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """``last_seq, pending``: where a page ends, and how many changes follow it. ``now`` is the log's last number."""
        if since == "now":
            return self.log.agg(F.coalesce(F.max("_seq"), F.lit(0).cast("long")).alias("last_seq")).withColumn("pending", F.lit(0).cast("long"))
        numbers = self.events(since).select("_seq")
        page = numbers.orderBy("_seq").limit(limit).select("_seq", F.lit(1).alias("n"))
        both = numbers.select("_seq", F.lit(0).alias("n")).unionByName(page)  # the feed below is one exchange, which Spark reuses
        return both.agg(F.max(F.when(F.col("n") == 1, F.col("_seq"))).alias("last_seq"), (F.count_if(F.col("n") == 0) - F.count_if(F.col("n") == 1)).alias("pending")).select(F.coalesce("last_seq", F.lit(since).cast("long")).alias("last_seq"), "pending")


def follow(log: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, filters: Sequence[Callable[[DataFrame], DataFrame]] = (), available_now: bool = True):
    """A continuous feed: ``sink`` gets each micro-batch's latest events, filtered, in order of nothing; the checkpoint resumes it.

    ``available_now`` drains what there is and stops, which is also how a long poll is made; a caller that waits for
    news no longer than some seconds calls ``awaitTermination`` with them on a query that goes on, and then ``stop``.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        rows = latest(batch)
        for f in filters:
            rows = f(rows)
        sink(rows, number)

    writer = log.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder (``spark.checkpoint.dir``), for a stream's progress or output; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='lakedoc-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def running_latest(log: DataFrame) -> DataFrame:
    """A streaming feed with state: in update mode, each id's row whenever its last event changes."""
    return latest(log)
