"""From raw documents to a weighted training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each result as Parquet in the cluster's shared folder and
reads it again for the next stage, so a lost executor costs one stage's tasks and no more.

Empty inputs give empty results; null texts have no language and leave in the first stage. Rows are told apart by themselves,
so ids may be null or repeated: each row is judged by its own text, and of equal texts one row stays. Other columns of
documents are carried to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakedoc.llm.decontaminate import drop_contaminated
from lakedoc.llm.language_id import drop_unidentified
from lakedoc.llm.line_dedup import dedup_lines
from lakedoc.llm.minhash import drop_near_duplicates
from lakedoc.llm.mixing import labelled_quality, mix
from lakedoc.llm.shared import discard, discard_all, mark, spill
from lakedoc.shipping import shipped


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that their labels teach."""
    return drop_unidentified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand on four sources or more; ``n_chars`` follows the text.

    A text whose copies alone stand on so many counts as one source, so that the next stage finds its text to keep. Each such line stays in the longest
    text that holds it, so texts that are nearly equal and stand on many sources are not lost in all their forms.
    """
    found = dedup_lines(docs, copies_once=True, keep_one=True, counts=False)
    return found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else found


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates (five words, similarity 0.8)."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in windows of the benchmark; they are left unchanged."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: ids with the words taken of each document, repeats counted."""
    quality = labelled_quality(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(docs, quality=quality).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language_id", shipped(language_id)), ("line_dedup", shipped(line_dedup)), ("near_dedup", shipped(near_dedup)), ("decontaminate", shipped(decontaminate)), ("mixing", shipped(mixing))]

#: The first stage learns a model, so SQL can't give the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = mark(spark)
        docs, last = spill(stage(spark, docs, sf_dir), name), docs
        discard_all(spark, before, keep=docs)  # what the stage wrote on its way
        discard(last)
    return docs
