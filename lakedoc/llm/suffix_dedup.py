"""Removal of long repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed.

1. Each window of ``length`` bytes is named by the least hash of the ``gram``-byte strings in it. Equal windows
   have equal names, consecutive windows of one name form a run, and only runs whose name
   occurs twice or more can hold a repeated window. Names are counted by a partial aggregation.
2. Texts of such runs are cut out once each and equal ones are counted, so thousands of copies cost one
   text. Runs of a name with ``hot`` runs or more are named anew by strings of ``length - 16`` bytes, so only
   texts that share those meet, and no common phrase gathers a share of the corpus in one task.
3. Texts go to buckets by name. Each bucket's texts lie in shards; a task sorts the suffixes of one shard and
   keeps its Burrows-Wheeler transform. Another merges the shards of a bucket: starting from prefixes of
   eight symbols, each round prepends as many symbols as a prefix has by each shard's LF mapping, applied that
   often, which interleaves the shards' suffixes in the order of prefixes twice as long.
   Intervals split where the intervals of the two halves differ; those of a single suffix, or only of texts that stand twice or more, are settled
   and leave. The suffixes of one interval have a common prefix of as many bytes as symbols were prepended, so
   the intervals left after ``length`` of them are the repeated strings. Longer common prefixes aren't needed, as overlapping windows add
   up to the whole repeat. A text that stands twice repeats as a whole and is merged only if a text that stands once shares its name.
   A name with more than ``NAME_BUCKETS`` buckets of distinct texts (one passage in many surroundings) is not merged: its
   windows are counted whole, by digest and partial aggregation, so no task holds all texts of one name.
4. Covered bytes return to the documents that hold the texts, and are merged to spans.

Defined cases: null and empty texts have no bytes; a text shorter than ``length`` loses nothing; copies of a text
of ``length`` bytes or more lose everything; repeated rows are copies; a null id is an id; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import sort_suffixes
from .shared import cut, discard, spill
from .textblocks import _BASE, _BYTE_VALUE, Block, blocks, mix64, powers

SHARDS = 4
NAME_BUCKETS = 4
MARK = 256
SPANS = "array<struct<lo:int,hi:int>>"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(n), out=sums[1:])
    m = n - gram + 1
    return mix64((sums[gram:] - sums[:m]) * powers(m, pow(_BASE, -1, 2**64)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones, from windows of powers of two."""
    span = 1
    m = x
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - span : width - span + len(x) - width + 1]) if span < width else m


def runs_of(block: Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Documents, names, first windows, last windows, and occurrences of the name's string, of all runs of a block."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64)) + (np.zeros(0, np.int64),) * 3
    if len(block.data) < length:
        return none
    h = gram_hashes(block.data, gram)
    name = sliding_min(h, length - gram + 1)
    inside = np.zeros(len(block.data) + 1, np.int8)
    long = np.flatnonzero(block.ends - block.starts >= length)
    if not len(long):
        return none
    inside[block.starts[long]] += 1
    inside[block.ends[long] - length + 1] -= 1
    ok = np.cumsum(inside, dtype=np.int8)[: len(name)].astype(bool)
    new = ok.copy()
    new[1:] &= (name[1:] != name[:-1]) | ~ok[:-1]
    new[block.starts[long]] = True
    first = np.flatnonzero(new)
    stop = ok.copy()
    stop[:-1] &= new[1:] | ~ok[1:]
    last = np.flatnonzero(stop)
    doc = np.searchsorted(block.starts[long], first, "right") - 1
    # occurrences of the name's string among the run's bytes
    value, which = np.unique(name[first], return_inverse=True)
    at = np.flatnonzero(h <= value[-1])
    k = np.searchsorted(value, h[at])
    hit = value[np.minimum(k, len(value) - 1)] == h[at]
    keys = np.sort(k[hit] * (len(h) + 1) + at[hit])
    low = which * (len(h) + 1)
    times = np.searchsorted(keys, low + last + length - gram, "right") - np.searchsorted(keys, low + first)
    return long[doc], name[first], first - block.starts[long][doc], last - block.starts[long][doc], times


def _runs(length: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(0))
            for block in blocks(batch.column(1)):
                doc, name, first, last, times = runs_of(block, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(rows[block.row0 + doc]), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(times, pa.int32())], names=["name", "row", "first", "last", "times"])

    return run


def _texts(length: int, long_gram: int) -> Callable:
    """(row, runs, text) to (digest, name, row, first, text where the task meets the digest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                out: list[tuple] = []
                for row, runs, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    for r in runs:
                        first, last, name = r["first"], r["last"], r["name"]
                        if not r["hot"]:
                            units = [(first, last, name)]
                        else:  # named anew by longer strings, so that only texts which share those meet
                            whole = np.frombuffer(text[first : last + length], np.uint8)
                            _, again, a, b, _ = runs_of(Block(whole, np.zeros(1, np.int64), np.array([len(whole)]), 0), length, long_gram)
                            units = list(zip((first + a).tolist(), (first + b).tolist(), again.view(np.int64).tolist(), strict=True))
                        for a, b, key in units:
                            piece = text[a : b + length]
                            digest = hashlib.blake2b(piece, digest_size=16).digest()
                            new = digest not in met
                            if new:
                                if len(met) >= 500_000:
                                    met.clear()
                                met.add(digest)
                            out.append((digest, key, row, a, piece if new else None))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=["digest", "name", "row", "first", "text"])

    return run


def transform(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Burrows-Wheeler transform of texts, each ended by 0 and its bytes raised by one (UTF-8 has none above 244), and its ``marks``.

    Marks are the rows of every ``MARK``-th position from the end of each text on, text by text.
    """
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).copy()
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1) - 1
    joined += 1
    joined[ends] = 0
    order = sort_suffixes(joined.astype(np.int64))
    row = np.empty(len(order), np.int32)
    row[order] = np.arange(len(order), dtype=np.int32)
    who, back = _marked(lengths)
    return joined[order - 1].tobytes(), row[ends[who] - back]


def _marked(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of each mark and its distance from the text's end."""
    n = lengths // MARK + 1
    who = np.repeat(np.arange(len(lengths)), n)
    return who, (np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)) * MARK


class Shard:
    """A transform with its LF mapping, and the text and position of each of its rows, recovered by walking from all marks at once."""

    def __init__(self, bwt: bytes, lengths: np.ndarray, marks: np.ndarray):
        self.bwt = np.frombuffer(bwt, np.uint8)
        order = np.argsort(self.bwt, kind="stable")
        n = len(self.bwt)
        self.lf = np.empty(n, np.int32)
        self.lf[order] = np.arange(n, dtype=np.int32)
        self.text = np.empty(n, np.int32)
        self.at = np.empty(n, np.int32)
        who, back = _marked(lengths)
        left = lengths[who] - back
        steps = np.minimum(left + 1, MARK)
        longest = np.argsort(-steps, kind="stable")
        who, left, row = who[longest], left[longest], marks[longest]
        going = np.searchsorted(-steps[longest], -np.arange(MARK))  # marks with a step left, the first ones
        walked = []
        for m in going[going > 0].tolist():
            row = row[:m]
            walked.append(row)
            row = self.lf[row]
        for k, rows in enumerate(walked):
            self.text[rows], self.at[rows] = who[: len(rows)], left[: len(rows)] - k


def _classes(keys: np.ndarray, light: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys that stand twice or more, at least once where ``light``, in the order of keys, and the interval of each."""
    order = np.argsort(keys)
    ordered = keys[order]
    start = np.ones(len(keys), bool)
    start[1:] = ordered[1:] != ordered[:-1]
    del ordered
    first = np.flatnonzero(start)
    if not len(first):
        return order, np.zeros(0, np.int32)
    size = np.diff(np.append(first, len(keys)))
    on = np.repeat((size >= 2) & np.logical_or.reduceat(light[order], first), size)
    return order[on], np.cumsum(start, dtype=np.int32)[on]


def repeated(shards: list[Shard], weights: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, text and position of every window of a text of weight 1 that is in an interval of two or more occurrences.

    ``weights``: how often each text stands in the corpus. Every window of a text that stands twice repeats, so these texts only serve the
    others. Each round prepends as many symbols as there are, by the LF mapping applied so often, which doubles them.
    """
    base = np.cumsum([0] + [len(s.bwt) for s in shards])
    lf = np.concatenate([s.lf + np.int32(b) for s, b in zip(shards, base, strict=False)])
    n_text = np.cumsum([0] + [len(w) for w in weights])
    text = np.concatenate([s.text + np.int32(k) for s, k in zip(shards, n_text, strict=False)])
    at = np.concatenate([s.at for s in shards])
    light = (np.concatenate(weights) < 2)[text]
    # as many symbols as a machine word holds
    key, back, span = np.concatenate([s.bwt for s in shards]).astype(np.uint64), lf, 1
    rest = length - (1 << (length.bit_length() - 1))
    hops = [lf] if rest & 1 else []
    while span < 8 and 2 * span <= length:
        key = key[back] << np.uint64(8 * span) | key
        back = back[back]
        span *= 2
        if rest & span:
            hops.append(back)
    rows = np.flatnonzero(at >= span).astype(np.int32)  # others would run out of text
    key = key[rows]
    on, interval = _classes(key, light[rows])
    del key
    place = np.full(len(at), -1, np.int32)  # interval of a row; none if it is settled
    rows = rows[on]
    place[rows] = interval

    def split(far: np.ndarray, size: int) -> None:
        """Intervals of strings of ``size`` symbols, from those of the row and of the row ``far`` before it."""
        nonlocal rows
        on = (at[rows] >= size) & (place[far] >= 0)
        keys = place[far[on]].astype(np.int64)
        del far
        keys *= len(at)
        keys += place[rows[on]]
        place[rows] = -1
        rows = rows[on]
        on, interval = _classes(keys, light[rows])
        rows = rows[on]
        place[rows] = interval

    while 2 * span <= length:
        split(back[rows], 2 * span)
        span *= 2
        if 2 * span <= length or rest & span:
            back = back[back]
        if rest & span:
            hops.append(back)
    if rest:  # the last strings overlap
        far = rows
        for hop in hops:
            far = hop[far]
        split(far, length)
    rows = rows[light[rows]]
    shard = np.searchsorted(n_text, text[rows], "right") - 1
    return shard, text[rows] - n_text[shard], at[rows] - length


def _transforms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a bucket, together and by shard, to a row for each shard with its transform.

    Where all texts of a name stand twice or more, all of them repeat as they are, so they are listed as ``whole`` and not transformed.
    """
    key, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        merged = {name for _, _, name, weight, _ in held if weight < 2}
        for shard, of_shard in itertools.groupby(held, key=lambda r: r[0]):
            rows = list(of_shard)
            kept = [r for r in rows if r[2] in merged]
            whole = [(r[1], len(r[4])) for r in rows if r[2] not in merged]
            bwt, marks = transform([r[4] for r in kept]) if kept else (b"", np.zeros(0, np.int32))
            values = ([key], [shard], [bwt], [marks], [[len(r[4]) for r in kept]], [[r[1] for r in kept]], [[r[3] for r in kept]], [[d for d, _ in whole]], [[n for _, n in whole]])
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["bucket", "shard", "bwt", "marks", "lengths", "digests", "weights", "whole", "whole_lengths"])

    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shard", "digest", "name", "weight", "text")), strict=True):
            if bucket != key:
                if held:
                    yield from flush()
                key, held = bucket, []
            held.append(row)
    if held:
        yield from flush()


def _merged(length: int) -> Callable:
    """Shards of a bucket, together, to the covered bytes of each text: (digest, spans)."""

    def flush(held: list[dict]) -> pa.RecordBatch:
        digests = [d for r in held for d in r["whole"]]
        found = [[{"lo": 0, "hi": n}] for r in held for n in r["whole_lengths"]]
        held = [r for r in held if r["lengths"]]
        if held:
            for digest, spans in merge(held):
                digests.append(digest)
                found.append(spans)
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(found, kind)], names=["digest", "spans"])

    def merge(held: list[dict]) -> Iterator[tuple[bytes, list[dict]]]:
        shards = [Shard(r["bwt"], np.array(r["lengths"], np.int64), np.array(r["marks"], np.int32)) for r in held]
        weights = [np.array(r["weights"], np.int64) for r in held]
        shard, text, at = repeated(shards, weights, length)
        order = np.lexsort((at, text, shard))
        shard, text, at = shard[order], text[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (shard[1:] != shard[:-1]) | (text[1:] != text[:-1]) | (at[1:] > at[:-1] + length)
        first = np.flatnonzero(new)
        spans: dict[tuple[int, int], list] = {}
        for a, b in zip(first, [*first[1:] - 1, len(at) - 1] if len(first) else [], strict=True):
            spans.setdefault((int(shard[a]), int(text[a])), []).append({"lo": int(at[a]), "hi": int(at[b]) + length})
        for k, w in enumerate(weights):
            for t in np.flatnonzero(w >= 2):
                spans[k, int(t)] = [{"lo": 0, "hi": held[k]["lengths"][t]}]
        for (k, t), merged in spans.items():
            yield held[k]["digests"][t], merged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if held and held[0]["bucket"] != row["bucket"]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return run


def _windows(length: int) -> Callable:
    """(digest, weight, text) to a row per window of the text: (window, digest, at, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["window", "digest", "at", "weight"])
            held.clear()
            return out

        for batch in batches:
            for digest, weight, text in zip(*(batch.column(c).to_pylist() for c in ("digest", "weight", "text")), strict=True):
                for at in range(len(text) - length + 1):
                    held.append((hashlib.blake2b(text[at : at + length], digest_size=16).digest(), digest, at, weight))
                    if len(held) >= 1 << 14:
                        yield flush()
        if held:
            yield flush()

    return run


def _counted(texts: DataFrame, length: int) -> DataFrame:
    """The covered bytes of each text, by counting its windows: (digest, spans)."""
    windows = spill(texts, "heavy").mapInArrow(_windows(length), "window binary, digest binary, at int, weight long")
    twice = cut(windows.groupBy("window").agg(F.sum("weight").alias("n")).where("n >= 2").select("window"))  # written, so that Spark may split a hot window in the join
    return windows.join(twice, "window", "left_semi").groupBy("digest").agg(F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))).alias("spans"))


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans in any order or null) to the merged spans and the digest of what they leave."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            sizes, removed, merged, left = [], [], [], []
            for text, spans in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                done: list[dict] = []
                for s in sorted(spans or (), key=lambda s: s["lo"]):
                    if done and s["lo"] <= done[-1]["hi"]:
                        done[-1]["hi"] = max(done[-1]["hi"], s["hi"])
                    else:
                        done.append(dict(s))
                digest, at = hashlib.sha256(), 0
                for s in done:
                    digest.update(text[at : s["lo"]])
                    at = s["hi"]
                digest.update(text[at:])
                sizes.append(len(text))
                removed.append(sum(s["hi"] - s["lo"] for s in done))
                merged.append(done)
                left.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, kind), pa.array(left, pa.string())], names=["id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, *, length: int = 200, gram: int = 32, hot: int = 50_000, bucket_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: its id, n_bytes, n_removed, spans (merged, in bytes, end excluded) and kept_sha256.

    Rows are numbered once, in a written table that every later step reads, so a retried task sees the same numbers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = spill(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "rows")
    long = rows.select("row", "text").where(F.octet_length("text") >= length)

    runs = spill(long.mapInArrow(_runs(length, gram), "name long, row long, first int, last int, times int"), "runs")
    names = runs.groupBy("name").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("runs")).where("times >= 2").select("name", (F.col("runs") >= hot).alias("hot"))
    listed = spill(runs.select("name", "row", "first", "last").join(names, "name").groupBy("row").agg(F.collect_list(F.struct("name", "first", "last", "hot")).alias("runs")), "listed")
    discard(runs)
    uses = spill(long.join(listed, "row").select("row", "runs", "text").mapInArrow(_texts(length, max(gram, length - 16)), "digest binary, name long, row long, first int, text binary"), "uses")
    discard(listed)

    sizes = cut(uses.where("text IS NOT NULL").groupBy("name").agg(F.sum(F.octet_length("text").cast("long")).alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = cut(sizes.where(F.col("n") > NAME_BUCKETS * bucket_bytes).select("name"))
    found, merged = [], uses
    if not heavy.isEmpty():
        texts = uses.join(heavy, "name", "left_semi").groupBy("digest").agg(F.first("text", ignorenulls=True).alias("text"), F.count(F.lit(1)).alias("weight"))
        found.append(_counted(texts.select("digest", "weight", "text"), length))
        merged = uses.join(heavy, "name", "left_anti")
    buckets = max(1, -(-total // bucket_bytes))
    # how often a text stands is summed before it is dealt; of the text itself a task deals one copy
    counts = merged.groupBy("digest", "name").agg(F.count(F.lit(1)).alias("weight")).withColumn("text", F.lit(None).cast("binary"))
    dealt = counts.unionByName(merged.where("text IS NOT NULL").select("digest", "name", F.lit(0).cast("long").alias("weight"), "text"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int")).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(SHARDS)).cast("int")).repartition("bucket")
    texts = dealt.groupBy("bucket", "shard", "digest").agg(F.first("name").alias("name"), F.first("text", ignorenulls=True).alias("text"), F.sum("weight").alias("weight"))  # within the partitions as they are
    parts = texts.sortWithinPartitions("bucket", "shard", "digest").mapInArrow(_transforms, "bucket int, shard int, bwt binary, marks array<int>, lengths array<int>, digests array<binary>, weights array<long>, whole array<binary>, whole_lengths array<int>")
    found.append(spill(parts.repartition("bucket").sortWithinPartitions("bucket", "shard").mapInArrow(_merged(length), f"digest binary, spans {SPANS}"), "found"))
    discard(sizes, heavy)

    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("first")).alias("lo"), (s["hi"] + F.col("first")).alias("hi")))
    of_row = uses.select("digest", "row", "first").join(functools.reduce(DataFrame.unionByName, found), "digest").groupBy("row").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    done = rows.join(of_row, "row", "left").select("id", "text", "spans")
    return done.mapInArrow(_covered, f"id {kind}, n_bytes long, n_removed long, spans {SPANS}, kept_sha256 string").withColumnRenamed("id", id_col)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
