"""Line dedup by distinct-site spread, in DataFrame functions alone.

A line is boilerplate if it stands on at least ``min_sites`` distinct sites. The sites of each
line's 64-bit hash are gathered in HyperLogLog sketches, which Spark merges by partial
aggregation, so a line on a third of all pages still moves one sketch per task. Estimates
far from the threshold decide at once; those within five standard errors of it are
counted exactly. Boilerplate lines are then removed from every document.

The hashes of boilerplate lines are written before they are joined. So Spark knows their size: below its broadcast
threshold lines aren't shuffled at all, beyond it both sides are, and Spark may split a hot line. Likewise
the lines to remove from each text, which are keyed by the text's digest: equal texts lose equal lines.

With ``copies_once``, a text whose copies alone stand on ``min_sites`` sites or more counts as one site (the
smallest of them), as else every line of it would be boilerplate and no copy would keep its text.

With ``keep_one``, each boilerplate line stays in the longest text that holds it (of equally long ones, that with the largest
digest) and in that text's copies. So of texts that are nearly the same and share most lines one stays whole.

Lines are the parts of a text between line feeds, compared without outer spaces, tabs and carriage returns; lines of
fewer than ``min_chars`` characters (blank ones too) are never judged or removed, as short lines are often the same by chance.

Defined cases: a null text has no lines and stays null; a null site is a site of its own; ids aren't read, so they may be
null or repeated; repeated rows count their site once; an empty table gives an empty
result; other columns are kept, whatever their names, but for the two that are added, which replace columns of their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    return F.xxhash64(_trimmed(line))


def _judged(text: Column, min_chars: int) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(_trimmed(x)) >= min_chars)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def boilerplate(docs: DataFrame, *, min_sites: int, min_chars: int, text_col: str, site_col: str, log_k: int = 10, copies_once: bool = False) -> DataFrame:
    """``line_key, sites``: the hash and the number of sites of each line on ``min_sites`` sites or more."""
    keys = docs.select(F.col(site_col).alias("site"), F.transform(_judged(F.col(text_col), min_chars), _key).alias("keys"), *[_digest(F.col(text_col)).alias("whole")] * copies_once)
    if copies_once:  # texts do not move, only the hashes of their lines
        spread = keys.where(F.size("keys") > 0).groupBy("whole", "site").agg(F.lit(1).alias("one")).groupBy("whole").agg(F.count(F.lit(1)).alias("sites"), F.min("site").alias("rep"))
        copied = cut(spread.where(F.col("sites") >= min_sites).select("whole", "rep"))  # written, so that Spark may split a hot text in the join
        keys = keys.join(copied, "whole", "left").select(F.coalesce("rep", "site").alias("site"), "keys")
    lines = keys.select(F.xxhash64("site").alias("site"), F.explode("keys").alias("line_key"))
    spread = lines.groupBy("line_key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", log_k)).alias("sites"))
    slack = 5 * 1.04 / math.sqrt(2**log_k)
    spread = cut(spread.where(F.col("sites") >= math.floor(min_sites * (1 - slack))))
    clear = spread.where(F.col("sites") > min_sites * (1 + slack))
    near = cut(spread.where(F.col("sites") <= min_sites * (1 + slack)).select("line_key"))
    exact = lines.join(near, "line_key", "left_semi").groupBy("line_key", "site").agg(F.lit(1).alias("one")).groupBy("line_key").agg(F.count(F.lit(1)).alias("sites"))
    found = cut(clear.unionByName(exact.where(F.col("sites") >= min_sites)))
    discard(spread, near)
    return found


def dedup_lines(docs: DataFrame, *, min_sites: int = 4, min_chars: int = 15, text_col: str = "text", site_col: str = "source", copies_once: bool = False, keep_one: bool = False, counts: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines out of ``text_col``, and columns ``n_lines`` and ``n_removed_lines`` (with ``counts``)."""
    common = boilerplate(docs, min_sites=min_sites, min_chars=min_chars, text_col=text_col, site_col=site_col, copies_once=copies_once).select("line_key")
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    size = [F.length(text_col).alias("size")] * keep_one
    held = docs.select(_digest(F.col(text_col)).alias("whole"), *size, F.explode(F.array_distinct(F.transform(_judged(F.col(text_col), min_chars), _key))).alias("line_key"))
    pairs = held.join(common, "line_key", "left_semi")
    pairs = cut(pairs) if keep_one else pairs  # read twice
    bad = pairs.groupBy("whole").agg(F.collect_set("line_key").alias("bad"))  # at most the distinct lines of one text in a row
    if keep_one:
        longest = pairs.groupBy("line_key").agg(F.max(F.struct("size", "whole"))["whole"].alias("whole"))
        stays = longest.groupBy("whole").agg(F.collect_set("line_key").alias("stays"))
        bad = bad.join(stays, "whole", "left").select("whole", F.when(F.col("stays").isNull(), F.col("bad")).otherwise(F.array_except("bad", "stays")).alias("bad"))
    bad = cut(bad)
    if keep_one:
        discard(pairs)
    rows = docs.select(F.struct(*quoted.values()).alias("row"), F.col(text_col).alias("text"), _digest(F.col(text_col)).alias("whole"))
    rows = rows.join(bad, "whole", "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~((F.length(_trimmed(x)) >= min_chars) & F.array_contains("bad", _key(x)))))
    rows = rows.select("row", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), kept.alias("kept"))
    rows = rows.select("row", "n_lines", (F.col("n_lines") - F.coalesce(F.size("kept"), F.lit(0))).alias("n_removed_lines"), F.when(F.col("kept").isNotNull(), F.concat_ws("\n", "kept")).alias("text"))
    added = ["n_lines", "n_removed_lines"] if counts else []
    return rows.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in added], *added)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
bad AS (SELECT trim(line, ' ' || chr(9) || chr(13)) AS line FROM l WHERE length(trim(line, ' ' || chr(9) || chr(13))) >= 15 GROUP BY 1 HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 4),
p AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts, generate_series(1, len(string_split(text, chr(10)))) AS k FROM documents),
u AS (SELECT doc_id, unnest(parts) AS line, unnest(k) AS k FROM p),
m AS (SELECT u.*, bad.line IS NULL AS keep FROM u LEFT JOIN bad ON trim(u.line, ' ' || chr(9) || chr(13)) = bad.line),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (keep), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN a USING (doc_id)
"""
