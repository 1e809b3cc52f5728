"""MinHash near-dedup by circulant signatures, banding and exact Jaccard verification.

A document's set is its distinct shingles of ``width`` words. Two fixed permutations of the
32-bit numbers give all signature coordinates (C-MinHash): the first scatters the shingles, the
second, shifted circularly by k, gives coordinate k as its minimum. Coordinates are
banded; with 40 bands of 6 a pair at the threshold of 0.8 is missed with probability 5e-6.

1. Documents with equal sets (equal size and two 64-bit digests) become one class, found by a
   partial aggregation, so thousands of copies cost one row from here on.
2. In each band bucket every class is joined to the smallest one: a star, never all pairs. The
   components of these stars are candidate clusters, which hold every candidate pair.
3. Shingle sets of clusters are dealt out in blocks of bounded bytes. Within a block the most typical
   document is compared with all others at once, then each one outside the largest component, until
   every pair across components has been compared: exact components without all pairs.
4. Clusters of several blocks: the typical documents of the blocks meet all blocks, and then all documents
   outside the cluster's largest component do, in chunks, which completes the pairs. A block and a chunk give one
   link for each document that they join to a smaller one, so links are as many as documents, not as pairs.

Links are between rows, which are numbered once in a written table, so ids may be of any type that has an order.

Defined cases: null or empty texts have empty sets and are linked with nothing; a text of fewer
words than ``width`` is one shingle; repeated rows are copies of each other; rows with one id are
documents of their own; a row without an id takes part, and a component without any id has none; an empty table gives no
rows; other columns have any names, and ``drop_near_duplicates`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut, discard, spill
from .textblocks import WHITE, blocks, mix64, shingle_hashes, word_hashes, words

BANDS, ROWS = 40, 6
#: Odd multipliers of the two permutations.
_SIGMA, _PI1, _PI2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def sets_of(block, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block."""
    w = words(block, WHITE)
    h, doc = shingle_hashes(word_hashes(block, w), w, width)
    cuts = np.searchsorted(doc, np.arange(len(block) + 1))
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s = np.sort(h[a:b])
        found.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b > a + 1 else s)
    return found


def signatures(sets: list[np.ndarray], k: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash coordinates of non-empty sets, one row each."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    x = np.concatenate(sets)
    scattered = ((x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)) * _SIGMA
    scattered ^= scattered >> np.uint32(16)
    scattered *= _PI1  # the second permutation's first step, which turns a shift by one into one addition
    out = np.empty((k, len(sets)), np.uint32)
    t, u = np.empty_like(scattered), np.empty_like(scattered)
    shift = np.uint32(0)
    with np.errstate(over="ignore"):
        for i in range(k):
            np.add(scattered, shift, out=t)
            np.right_shift(t, np.uint32(15), out=u)
            np.bitwise_xor(t, u, out=t)
            np.multiply(t, _PI2, out=t)
            np.right_shift(t, np.uint32(13), out=u)
            np.bitwise_xor(t, u, out=t)
            np.multiply(t, _PI1, out=t)
            np.minimum.reduceat(t, starts, out=out[i])
            shift = np.uint32(shift + _PI1)
    return out.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each document and band; keys of different bands differ."""
    grouped = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), grouped.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key ^ grouped[:, :, r]) + np.uint64(r)
    return key.view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(mix64(s).sum(dtype=np.uint64).astype(np.int64)), int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))


def _summaries(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = sets_of(block, width)
                digests = [_digest(s) for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [[]] * len(sets)
                if full:
                    for i, row in zip(full, band_keys(signatures([sets[i] for i in full])), strict=True):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.row0, len(block)), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["row", "n", "h1", "h2", "bands"],
                )

    return run


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(block.row0, len(block)) for c in range(3)], pa.array([s.tobytes() for s in sets_of(block, width)], pa.binary())], names=["rep", "cluster", "n_blocks", "shingles"])

    return run


class Sets:
    """Shingle sets of one block as small numbers, compared with one set at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.shingles, self.number = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(self.shingles), bool)

    def linked(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Which sets have 100 * intersection >= percent * union with the query."""
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        self.flag[at] = True
        common = np.add.reduceat(self.flag[self.number], self.starts, dtype=np.int64)
        self.flag[at] = False
        return 100 * common >= percent * (len(query) + self.sizes - common)

    def typical(self) -> int:
        """The set whose shingles are in most sets on average."""
        return int(np.argmax(np.add.reduceat(np.bincount(self.number)[self.number], self.starts) / self.sizes))


def closure(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, int]:
    """Component number of each set, exact, and the typical set."""
    n = len(sets)
    group = np.arange(n)
    if n == 1:
        return group, 0
    held = Sets(sets)
    pivot = typical = held.typical()
    done = np.zeros(n, bool)
    while True:
        done[pivot] = True
        joined = np.unique(group[held.linked(sets[pivot], percent)])
        group[np.isin(group, joined)] = joined[0]
        rest = np.flatnonzero((group != np.bincount(group).argmax()) & ~done)
        if not len(rest):
            return group, typical
        pivot = int(rest[0])


def _within(percent: int) -> Callable:
    """Blocks, each with its rows together, to (rep, cluster, block, group, pivot, shingles where another stage needs them)."""

    def flush(key, reps, sets) -> pa.RecordBatch:
        group, typical = closure(sets, percent)
        least = np.full(len(sets), np.iinfo(np.int64).max)
        np.minimum.at(least, group, np.array(reps))
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array([key[0]] * len(reps), pa.int64()), pa.array([key[1]] * len(reps), pa.int32()), pa.array(least[group], pa.int64()), pa.array(np.arange(len(sets)) == typical)], names=["rep", "cluster", "block", "grp", "pivot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, sets = None, [], []
        out: list[pa.RecordBatch] = []
        for batch in batches:
            for cluster, block, rep, shingles in zip(*(batch.column(c).to_pylist() for c in ("cluster", "block", "rep", "shingles")), strict=True):
                if (cluster, block) != key:
                    if reps:
                        out.append(flush(key, reps, sets))
                        if len(out) >= 1000:
                            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                            out = []
                    key, reps, sets = (cluster, block), [], []
                reps.append(rep)
                sets.append(np.frombuffer(shingles, np.uint64))
        if reps:
            out.append(flush(key, reps, sets))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def joined(reps: list[int], sets: list[np.ndarray], asked: list[tuple[int, np.ndarray]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document of a block and of its queries that is linked, with the least one it is joined to: never more links than documents."""
    nodes = np.unique(np.array([*reps, *(rep for rep, _ in asked)], np.int64))
    group = np.arange(len(nodes))
    held, at = Sets(sets), np.searchsorted(nodes, np.array(reps))
    for rep, query in asked:
        met = np.append(at[held.linked(query, percent)], np.searchsorted(nodes, rep))
        if len(both := np.unique(group[met])) > 1:
            group[np.isin(group, both)] = both[0]
    moved = np.flatnonzero(group != np.arange(len(nodes)))
    return nodes[moved], nodes[group[moved]]


def _across(percent: int) -> Callable:
    """Rows of one block and chunk of queries together, queries first, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, sets, asked = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if sets and asked:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in joined(reps, sets, asked, percent)], names=["a", "b"])

        for batch in batches:
            for cluster, block, chunk, query, rep, shingles in zip(*(batch.column(c).to_pylist() for c in ("cluster", "block", "chunk", "query", "rep", "shingles")), strict=True):
                if (cluster, block, chunk) != key:
                    yield from flush()
                    key, reps, sets, asked = (cluster, block, chunk), [], [], []
                s = np.frombuffer(shingles, np.uint64)
                if query:
                    asked.append((rep, s))
                else:
                    reps.append(rep)
                    sets.append(s)
        yield from flush()

    return run


def _meet(sets: DataFrame, queries: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links of ``queries`` (rep, cluster, n_blocks, shingles) with all blocks of their clusters, queries in chunks of bounded bytes."""
    chunks = queries.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("shingles").cast("long")) / block_bytes).cast("int").alias("chunks"))
    asked = queries.join(chunks, "cluster").select("rep", "cluster", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("query"), "shingles")
    held = sets.join(chunks, "cluster").select("rep", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("query"), "shingles")
    return asked.unionByName(held).repartition("cluster", "block", "chunk").sortWithinPartitions("cluster", "block", "chunk", F.desc("query")).mapInArrow(_across(percent), "a long, b long")


def _components(rows: DataFrame, *, width: int, percent: int, block_bytes: int) -> DataFrame:
    """(row, n, component) for written ``rows`` (row, text): the smallest row number that links lead to."""
    sums = cut(rows.select("row", "text").mapInArrow(_summaries(width), "row long, n long, h1 long, h2 long, bands array<long>"))
    own = sums.where("n > 0")
    copies = cut(own.groupBy("n", "h1", "h2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))  # written, so that its joins shuffle both sides and Spark may split a hot class
    member = cut(sums.join(copies, ["n", "h1", "h2"], "left").select("row", "n", F.coalesce("rep", "row").alias("rep")))

    keys = own.join(copies, ["n", "h1", "h2"], "left").where("rep IS NULL OR rep = row").select("row", F.explode("bands").alias("band"))
    buckets = cut(keys.groupBy("band").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first <> last").select("band", "first"))  # written for the same reason: a group of near copies shares its bands
    clusters = connected_components(keys.join(buckets, "band").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct()).withColumnsRenamed({"node": "rep", "component": "cluster"})
    discard(sums, copies, buckets)

    clusters = clusters.join(member.where("row = rep").select("rep", "n"), "rep")
    counted = cut(clusters.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") * 8) / block_bytes).cast("int").alias("n_blocks")))
    clusters = clusters.join(counted, "cluster").select("rep", "cluster", "n_blocks")
    sets = clusters.join(rows.select(F.col("row").alias("rep"), "text"), "rep").select("rep", "cluster", "n_blocks", "text").mapInArrow(_sets(width), "rep long, cluster long, n_blocks int, shingles binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    inner = cut(sets.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(_within(percent), "rep long, cluster long, block int, grp long, pivot boolean"))

    edges = inner.where("rep <> grp").select(F.col("rep").alias("a"), F.col("grp").alias("b"))
    large = counted.where("n_blocks > 1").select("cluster")
    split = inner.join(large, "cluster", "left_semi")
    if split.isEmpty():  # groups of whole clusters are components
        labels = inner.select(F.col("rep").alias("node"), F.col("grp").alias("component"))
    else:
        sets = cut(sets.join(large, "cluster", "left_semi"))
        links = edges.join(split.select(F.col("rep").alias("a")), "a", "left_semi")
        pivots = split.where("pivot").select("rep", "cluster")
        links = cut(links.unionByName(_meet(sets, sets.join(pivots, ["rep", "cluster"], "left_semi"), percent, block_bytes)).distinct())
        so_far = cut(split.select("rep", "cluster").join(connected_components(links), F.col("rep") == F.col("node"), "left").select("rep", "cluster", F.coalesce("component", "rep").alias("component")))
        largest = so_far.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max_by("component", F.struct("c", "component")).alias("component"))
        outside = so_far.join(largest, ["cluster", "component"], "left_anti").select("rep", "cluster")
        links = links.unionByName(_meet(sets, sets.join(outside, ["rep", "cluster"], "left_semi"), percent, block_bytes))
        labels = connected_components(edges.unionByName(links))
    labels = cut(labels)
    found = cut(member.join(labels, F.col("rep") == F.col("node"), "left").select("row", "n", F.coalesce("component", "rep").alias("component")))
    discard(member, counted, inner, labels)
    return found


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (it is the component's smallest id) and first (one row of each component) for each row of ``docs``."""
    rows = spill(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "rows")
    return _labelled(rows.select("row", "doc_id"), _components(rows, width=width, percent=percent, block_bytes=block_bytes)).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "first")


def _labelled(ids: DataFrame, components: DataFrame) -> DataFrame:
    """(row, doc_id) and (row, n, component) to row, doc_id, n, component_id (its smallest id) and first (the row with that id, or the least of several)."""
    rows = cut(components.join(ids, "row"))
    least = cut(rows.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("first_row"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))  # written, so that Spark may split a hot component
    both = rows.join(least, "component", "left")
    return both.select("row", "doc_id", "n", F.when(F.col("first_row").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)).alias("first"))


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id (rows without an id come last)."""
    rows = spill(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    field = lambda c: F.col("doc")[c]
    found = _components(rows.select("row", field(text_col).cast("string").alias("text")), width=width, percent=percent, block_bytes=block_bytes)
    gone = cut(_labelled(rows.select("row", field(id_col).alias("doc_id")), found).where("NOT first").select("row"))
    discard(found)
    return rows.join(gone, "row", "left_anti").select("doc.*")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4).select("doc_id", "n_shingles", "component_id", "kept")
