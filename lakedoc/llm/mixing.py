"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources get targets by weight, capped at a number of epochs, the excess reshared
(water-filling). Each document has the exponential key ``-ln(u) / quality`` with ``u`` from
a hash of its id, so reruns agree. Every document is taken as many whole times as its
source's target holds the whole source; the rest of the target is filled in order of the
keys by a prefix sum, and the document in which it is reached gives its first words only.

All prefix sums, over documents and over sources, run in two steps: rows are dealt into ranges of the order, the
ranges are summed, and sums within a range start from those of the ranges before. So neither a source
holding a third of all rows nor a great number of sources is a single task.

Defined cases: null or empty text has size 0 and gives 0; a null source is a source, ranked
last; null or non-positive quality counts as 1; rows of one id are ordered by size and a hash of the text, so that
only equal rows are interchangeable; rows without an id get their key from the text's hash; an empty table gives an empty mix;
other columns of ``docs`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, spill

WORD = r"[^\x20\x09-\x0D]+"


def uniform_of(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def with_sums_before(rows: DataFrame, sums: dict[str, str], order: Sequence[str], within: str | None = None) -> DataFrame:
    """``rows`` with, by new name, the sum of a column over all rows before this one in the order (of the same ``within``). Nulls come last.

    The ranges are written before they are used, as their limits come from a sample.
    """
    by = [within] if within else []
    ranged = spill(rows.repartitionByRange(*[F.col(c).asc_nulls_last() for c in [*by, *order]]).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "range").agg(*[F.sum(c).alias(f"{n}_all") for n, c in sums.items()])
    totals = totals.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("range").alias("range_of"), *[F.coalesce(F.sum(f"{n}_all").over(before), F.lit(0)).alias(f"{n}_start") for n in sums])
    inside = Window.partitionBy(*by, "range").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{n}_inside") for n, c in sums.items()])
    same = F.col("range") == F.col("range_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    kept = [c for c in ranged.columns if c != "range"]
    return rows.join(totals, same).select(*kept, *[(F.col(f"{n}_start") + F.col(f"{n}_inside")).alias(n) for n in sums])


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """``source, source_size`` to the same with ``target``."""
    ranked = with_sums_before(sizes.withColumn("one", F.lit(1)), {"rank": "one"}, ["source"])
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight")).select("source", "source_size", "weight", "cap", "ratio")
    filled = spill(with_sums_before(ranked, {"caps_before": "cap", "weights_before": "weight"}, ["ratio", "source"]), "targets")
    total, mass = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.sum("weight")).first()
    # the level at which all sources below their cap are filled, if those of lower ratio are at theirs
    level = (F.lit(total) - F.col("caps_before")) / (F.lit(mass) - F.col("weights_before"))
    found = filled.withColumn("level", level).agg(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level")))["level"]).first()[0]
    return filled.select("source", "source_size", F.least("cap", F.col("weight") * found if found is not None else F.col("cap")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    quality: DataFrame | None = None,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, quality, sample_key, source_size, target, taken.

    ``quality``: at most one row for each doc_id with its sampling weight; without one, all weigh 1.
    """
    text = F.col(text_col).cast("string")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    if quality is not None:
        sized = sized.join(quality.select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")
    else:
        sized = sized.withColumn("quality", F.lit(1.0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_hash").cast("string")))
    sized = sized.withColumn("quality", F.when(F.col("quality") > 0, F.col("quality")).otherwise(1.0)).withColumn("sample_key", -F.log(uniform_of(key, seed)) / F.col("quality"))
    rows = spill(with_sums_before(sized, {"before": "size"}, ["sample_key", "doc_id", "size", "text_hash"], within="source"), "mix")
    per_source = spill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = spill(source_targets(per_source, weights, max_epochs), "targets")  # written, so that Spark may broadcast it by its size or split a hot source
    discard(per_source)
    rows = rows.join(targets.withColumnRenamed("source", "source_of"), F.col("source").eqNullSafe(F.col("source_of")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return rows.select("doc_id", "source", "size", "quality", "sample_key", "source_size", "target", taken.cast("long").alias("taken"))


def labelled_quality(labels: DataFrame, good: float = 2.0, bad: float = 0.25) -> DataFrame:
    """Sampling weights from a table of labels: doc_id, quality. Several labels of one document are averaged."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("q")).select("doc_id", F.when(F.col("q") >= 0.5, good).when(F.col("q") < 0.5, bad).otherwise(1.0).alias("quality"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality = labelled_quality(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(docs, quality=quality).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH q AS (SELECT doc_id, avg(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || d.doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
           / CASE WHEN q.q >= 0.5 THEN 2.0 WHEN q.q < 0.5 THEN 0.25 ELSE 1.0 END AS k
  FROM documents d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
        ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lev, ratio) FROM l WHERE ratio >= lev) * weight, cap)) AS target FROM l),
e AS (SELECT sized.*, source_size, target, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs,
        coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(floor(target) - epochs * source_size - before, size)))::BIGINT AS taken
FROM e
"""
