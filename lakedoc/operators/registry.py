"""Registries: secondary indexes, collections, and update functions.

An index is a promise about layout: ``write_indexed`` sorts or buckets a collection by its fields, so that Parquet statistics or
bucket pruning answer equality lookups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALL_DOCS = {"ddoc": None, "name": "_all_docs", "type": "special", "fields": ["_id"]}


@dataclass
class IndexRegistry:
    indexes: list[dict] = field(default_factory=list)

    def create(self, fields: Sequence[str], name: str | None = None, ddoc: str | None = None) -> str:
        """``created``, or ``exists`` if the same index is there."""
        own = "by-" + "-".join(fields)
        index = {"ddoc": ddoc or f"_design/{own}", "name": name or own, "type": "json", "fields": list(fields)}
        if any(i["fields"] == index["fields"] and i["name"] == index["name"] and i["ddoc"] == index["ddoc"] for i in self.indexes):
            return "exists"
        self.indexes.append(index)
        return "created"

    def delete(self, ddoc: str, name: str) -> bool:
        kept = [i for i in self.indexes if (i["ddoc"], i["name"]) != (ddoc, name)]
        gone = len(kept) < len(self.indexes)
        self.indexes = kept
        return gone

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [ALL_DOCS, *sorted(self.indexes, key=lambda i: (i["ddoc"], i["name"]))]
        return spark.createDataFrame([(i["ddoc"], i["name"], i["type"], i["fields"]) for i in rows], "ddoc string, name string, type string, fields array<string>")


def write_indexed(docs: DataFrame, path: str, fields: Sequence[str], files: int | None = None) -> None:
    """Range-partitioned and sorted by the fields, so each file covers a narrow range of them."""
    parts = docs.repartitionByRange(files, *fields) if files else docs.repartitionByRange(*fields)
    parts.sortWithinPartitions(*fields).write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, values: dict) -> DataFrame:
    """Rows of a layout whose fields have the values; statistics of its files and row groups rule out most of it."""
    rows = spark.read.parquet(path)
    for name, value in values.items():
        rows = rows.where(F.col(name) == value)
    return rows


def layout_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``files, bytes, rows`` of a layout."""
    files = spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.first("_metadata.file_size").alias("size"), F.count(F.lit(1)).alias("n"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def databases(names: DataFrame, *, startkey: str | None = None, endkey: str | None = None, skip: int = 0, limit: int | None = None, descending: bool = False) -> DataFrame:
    """Names of collections (a column ``name``) in a range, in order."""
    low, high = (endkey, startkey) if descending else (startkey, endkey)
    rows = names.where(F.col("name") >= low) if low is not None else names
    rows = rows.where(F.col("name") <= high) if high is not None else rows
    rows = rows.orderBy(F.col("name").desc() if descending else "name")
    rows = rows.offset(skip) if skip else rows
    return rows.limit(limit) if limit is not None else rows


def database_updates(log: DataFrame) -> DataFrame:
    """``db_name, type, seq``: collections that a log of writes (db_name, _seq) tells of, each with its last number."""
    return log.groupBy("db_name").agg(F.max("_seq").alias("seq")).select("db_name", F.lit("updated").alias("type"), "seq")


def update(docs: DataFrame, handler: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An update function: from documents to the rows to write, which must keep ``_id``."""
    out = handler(docs)
    if "_id" not in out.columns:
        raise ValueError("an update keeps _id")
    return out
