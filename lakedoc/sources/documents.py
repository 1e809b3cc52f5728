"""Sources and sinks of collections: JSON lines, Parquet tables partitioned by id prefix, attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collection import Collection


def read_json_lines(spark: SparkSession, path: str, id_field: str = "_id") -> Collection:
    """One document a line, of any shape; the id comes from its field, other members stay in a VARIANT body."""
    body = spark.read.text(path).select(F.try_parse_json("value").alias("body")).where("body IS NOT NULL")
    get = lambda name, kind: F.try_variant_get("body", f"$['{name}']", kind)
    return Collection(body.select(get(id_field, "string").alias("_id"), get("_rev", "string").alias("_rev"), F.coalesce(get("_deleted", "boolean"), F.lit(False)).alias("_deleted"), "body"), body="body")


def write_json_lines(collection: Collection, path: str) -> None:
    docs = collection.docs
    text = F.to_json(F.col(collection.body)) if collection.body else F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    docs.select(text.alias("value")).write.mode("overwrite").text(path)


def write_partitioned(collection: Collection, path: str) -> None:
    """Parquet with a folder per id prefix, so that partition queries prune folders."""
    collection.docs.withColumn("_partition", F.split_part("_id", F.lit(":"), F.lit(1))).write.partitionBy("_partition").mode("overwrite").parquet(path)


def read_partition(spark: SparkSession, path: str, name: str) -> Collection:
    return Collection(spark.read.parquet(path).where(F.col("_partition") == name).drop("_partition"))


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """Files as attachments: name, length, digest and content; only wanted columns are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return as_attachments(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content"))


def as_attachments(rows: DataFrame, content: str = "content") -> DataFrame:
    """Rows with a binary content as attachments: ``length`` and ``digest`` come of the content; a null content has neither."""
    return rows.withColumn("length", F.octet_length(content).cast("long")).withColumn("digest", F.concat(F.lit("md5-"), F.base64(F.unhex(F.md5(content)))))


def attachment_references(attachments: DataFrame) -> DataFrame:
    """``digest, length, refs``: each content once, with how often it is attached."""
    return attachments.groupBy("digest").agg(F.first("length").alias("length"), F.count(F.lit(1)).alias("refs"))
