"""Benchmark decontamination with one FM-index per shard of the documents.

A shard is a block of whole documents as a sequence of word numbers. Numbers come from the
sorted words of the benchmark; runs of other words, and ends of documents, become one
separator, since no test phrase holds them. The shard's suffixes are sorted up to their
separators, the Burrows-Wheeler transform is stored as a wavelet matrix of bit vectors
with counted blocks, and all phrases are searched backwards at once by its ranks. Occurrences are
located by walking to sampled suffix positions, become spans of words, and are merged.

Test phrases are windows of ``width`` consecutive words of each item (a shorter, non-empty item is one
window). They are broadcast in blocks of at most ``most_words`` words (or one longer item). Each block passes over all
documents; its spans are written and its broadcast is destroyed before the next one is made, so one block is
held at a time whatever the benchmark holds. The spans of all blocks are merged by document.

Defined cases: null and empty texts have no words; items without words match nothing; rows of one item_id are one item, and
those without an id are the item ``null``; repeated rows of documents each count for themselves, whatever their ids; an empty
benchmark hits nothing; other columns have any names, and ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .shared import spill
from .textblocks import NOT_ALNUM, Words, blocks, word_hashes, words

SAMPLE = 16
WORD_BITS = 64


class BitVector:
    """Bits packed in 64-bit words, with the ones counted up to each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // WORD_BITS + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts
        self.n, self.ones = n, int(counts.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones in positions below i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access over a sequence of small numbers, one bit vector for each bit from the highest."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[BitVector, int]] = []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            level = BitVector(bit)
            zeros = level.n - level.ones
            self.levels.append((level, zeros))
            values = np.concatenate([values[~bit], values[bit]])
        self.bits = bits

    def start(self, symbol: np.ndarray) -> np.ndarray:
        """Where the symbol's run begins on the lowest level; ranks are counted from here."""
        return self._down(symbol, np.zeros(len(symbol), np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (level, zeros), b in zip(self.levels, range(self.bits - 1, -1, -1), strict=True):
            ones = level.rank1(i)
            i = np.where(symbol >> b & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in positions below i."""
        return self._down(symbol, i) - self._begin[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and how often each occurs below."""
        symbol = np.zeros(len(i), np.int64)
        for level, zeros in self.levels:
            bit = level.get(i).astype(np.int64)
            ones = level.rank1(i)
            i = np.where(bit, zeros + ones, i - ones)
            symbol = symbol << 1 | bit
        return symbol, i - self._begin[symbol]

    def prepare(self, n_symbols: int) -> WaveletMatrix:
        self._begin = self.start(np.arange(n_symbols, dtype=np.int64))
        return self


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes cut at their first 0 (``text`` ends with one); equal ones by position.

    As many symbols as a machine word holds are sorted at once, then groups of still equal
    suffixes are split by the ranks of what follows, twice as far each round.
    """
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    length = zeros[np.searchsorted(zeros, np.arange(n))] - np.arange(n)
    bits = max(1, int(text.max()).bit_length())
    span = 62 // bits
    key = np.zeros(n, np.int64)
    for k in range(span):
        key <<= bits
        if k < n:
            key[: n - k] |= np.where(length[: n - k] > k, text[k:], 0)
    order = np.argsort(key)
    order[: len(zeros)] = zeros
    ordered = key[order]
    start = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    tied = ~start | ~np.concatenate([start[1:], [True]])
    tied[: len(zeros)] = False  # suffixes that start with 0 stay in the order of their positions
    rows = np.flatnonzero(tied)
    ended: list[np.ndarray] = []
    while len(rows):
        at = order[rows]
        over = length[at] < span
        ended.append(rows[over])
        rows, at = rows[~over], at[~over]
        if not len(rows):
            break
        pair = rank[at] * n + rank[at + span]
        o = np.argsort(pair)
        order[rows], pair = at[o], pair[o]
        start[rows[1:]] |= pair[1:] != pair[:-1]
        rank[order[rows]] = np.maximum.accumulate(np.where(start[rows], rows, 0))
        rows = rows[~(start[rows] & np.concatenate([start, [True]])[rows + 1])]
        span *= 2
    if ended:
        rows = np.sort(np.concatenate(ended))
        at = order[rows]
        order[rows] = at[np.lexsort((at, rank[at]))]
    return order


class FmIndex:
    """Backward search and location over one shard of word numbers (0: separator)."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        order = sort_suffixes(text)
        n = len(text)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.wavelet = WaveletMatrix(bwt, max(1, int(n_symbols - 1).bit_length())).prepare(n_symbols)
        sampled = (order % SAMPLE == 0) | (bwt == 0)  # a walk never needs to pass a separator
        self.marked = BitVector(sampled)
        self.samples = order[sampled]
        self.n = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases, which end at the last column."""
        width = phrases.shape[1]
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(width - 1, -1, -1):
            alive = alive[(lo[alive] < hi[alive])]
            now = alive[lengths[alive] >= width - k]
            if not len(now):
                break
            symbol = phrases[now, k]
            lo[now] = self.first[symbol] + self.wavelet.rank(symbol, lo[now])
            hi[now] = self.first[symbol] + self.wavelet.rank(symbol, hi[now])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by steps to the left up to a sampled position."""
        at = np.full(len(rows), -1, np.int64)
        rows = rows.copy()
        todo = np.arange(len(rows))
        steps = 0
        while len(todo):
            here = rows[todo]
            found = self.marked.get(here).astype(bool)
            at[todo[found]] = self.samples[self.marked.rank1(here[found])] + steps
            todo = todo[~found]
            symbol, before = self.wavelet.access(rows[todo])
            rows[todo] = self.first[symbol] + before
            steps += 1
        return at


def benchmark_blocks(benchmark: DataFrame, *, most_words: int, id_col: str, text_col: str) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Word hashes of items, item ends, and item ids, in blocks that hold up to ``most_words`` words (or one longer item)."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                w = words(block, NOT_ALNUM)
                h = word_hashes(block, w)
                rows = [h[a:b].tobytes() for a, b in zip(w.lo, w.hi, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row0, len(block)), pa.array(rows, pa.binary())], names=["item", "words"])

    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string")).mapInArrow(run, f"item {kind}, words binary").where(F.octet_length("words") > 0)
    held: list[np.ndarray] = []
    ids: list = []
    for row in items.toLocalIterator():  # one partition of the test set at a time; a block of it is what is broadcast
        h = np.frombuffer(bytes(row["words"]), np.uint64)
        if held and sum(map(len, held)) + len(h) > most_words:
            yield np.concatenate(held), np.cumsum([len(x) for x in held]), ids
            held, ids = [], []
        held.append(h)
        ids.append(row["item"])
    if held:
        yield np.concatenate(held), np.cumsum([len(x) for x in held]), ids


def phrases_of(hashes: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted vocabulary, distinct phrases as numbers from 1 (right-aligned, 0 before shorter ones), their lengths, and (phrase, item) pairs."""
    vocabulary = np.unique(hashes)
    number = np.searchsorted(vocabulary, hashes) + 1
    starts = np.concatenate([[0], ends[:-1]])
    rows, items = [], []
    for item, (a, b) in enumerate(zip(starts, ends, strict=True)):
        if b - a >= width:
            rows.append(np.lib.stride_tricks.sliding_window_view(number[a:b], width))
        else:
            short = np.zeros((1, width), number.dtype)
            short[0, width - (b - a) :] = number[a:b]
            rows.append(short)
        items.append(np.full(len(rows[-1]), item))
    phrases, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(items)], 1), axis=0)
    return vocabulary, phrases, (phrases > 0).sum(1), pairs


def numbers_of(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """1 + place in the sorted vocabulary, 0 for other words."""
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at + 1, 0)


def shard_of(number: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The shard's text (word numbers, one 0 between runs and documents) and the word at each position."""
    known = number > 0
    breaks = np.zeros(len(number) + 1, bool)
    breaks[w.lo] = True
    breaks = breaks[: len(number)]
    new_run = known & (~np.concatenate([[False], known[:-1]]) | breaks)
    at = np.flatnonzero(known)
    place = np.arange(len(at)) + np.cumsum(new_run[at])
    text = np.zeros((int(place[-1]) if len(at) else 0) + 2, np.int64)
    word = np.full(len(text), -1, np.int64)
    text[place], word[place] = number[at], at
    return text, word


def find_spans(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, most_words: int = 1 << 20, shard_words: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: its id, n_words, spans (merged, in words, end excluded) and items (ids as sorted strings)."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).alias("row"))
    found = _found(rows, benchmark, width=width, most_words=most_words, shard_words=shard_words, text_col="text", item_col=item_col, item_text_col=item_text_col, kept=["id"])
    return found.select(F.col("row.id").alias(id_col), "n_words", "spans", "items")


def _found(rows: DataFrame, benchmark: DataFrame, *, width: int, most_words: int, shard_words: int, text_col: str, item_col: str, item_text_col: str, kept: list[str]) -> DataFrame:
    """``row`` (its fields ``kept``), n_words, spans and items of each row of ``rows``, a column ``row`` with a text field."""
    whole = rows.schema["row"].dataType
    held = StructType([whole[c] for c in kept])
    span = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
    spark = rows.sparkSession

    def schema(row: StructType) -> StructType:
        spans = ArrayType(StructType().add("lo", "long").add("hi", "long"))
        return StructType().add("row", row).add("n_words", "long").add("spans", spans).add("items", ArrayType(StringType()))

    def scanner(bench, kept: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = bench.value if bench is not None else None
            for batch in batches:
                row = batch.column(0)
                carried = pa.StructArray.from_arrays([row.field(c) for c in kept], names=kept)
                for block in blocks(row.field(text_col), shard_words * 6):
                    w = words(block, NOT_ALNUM)
                    spans, items = [[]] * len(block), [[]] * len(block)
                    if model is not None:
                        for d, (s, i) in scan(block, w, *model).items():
                            spans[d], items[d] = s, i
                    yield pa.RecordBatch.from_arrays([carried.slice(block.row0, len(block)), pa.array(w.hi - w.lo, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

        return run

    def scan(block, w, vocabulary, phrases, lengths, pairs, ids):
        number = numbers_of(word_hashes(block, w), vocabulary)
        text, word = shard_of(number, w)
        index = FmIndex(text, len(vocabulary) + 1)
        lo, hi = index.search(phrases, lengths)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return {}
        n = hi[hit] - lo[hit]
        which = np.repeat(hit, n)
        suffix = np.repeat(lo[hit], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = word[index.locate(suffix)]
        doc = np.searchsorted(w.lo, at, "right") - 1
        found: dict[int, tuple[list, list]] = {}
        first, last = np.searchsorted(pairs[:, 0], hit), np.searchsorted(pairs[:, 0], hit, "right")
        items_of = {int(p): pairs[a:b, 1] for p, a, b in zip(hit, first, last, strict=True)}
        order = np.lexsort((at, doc))
        doc, at, which = doc[order], at[order], which[order]
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for a, b in zip(edges, [*edges[1:], len(doc)], strict=True):
            begin = at[a:b] - w.lo[doc[a]]
            end = np.maximum.accumulate(begin + lengths[which[a:b]])
            cuts = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
            merged = [{"lo": int(x), "hi": int(y)} for x, y in zip(begin[cuts], end[np.concatenate([cuts[1:] - 1, [b - a - 1]])], strict=True)]
            held = np.unique(np.concatenate([items_of[int(p)] for p in np.unique(which[a:b])]))
            found[int(doc[a])] = (merged, sorted({"null" if ids[i] is None else str(ids[i]) for i in held}))
        return found

    tests = benchmark_blocks(benchmark, most_words=most_words, id_col=item_col, text_col=item_text_col)
    first, second = next(tests, None), next(tests, None)
    send = lambda block: spark.sparkContext.broadcast((*phrases_of(block[0], block[1], width), block[2]))
    if second is None:
        return rows.mapInArrow(scanner(send(first) if first is not None else None, kept), schema(held))
    # several blocks of a large benchmark: rows are numbered once, in a written table, and the spans of all blocks are merged natively
    numbered = spill(rows.select(F.monotonically_increasing_id().alias("number"), "row"), "numbered")
    texts = numbered.select(F.struct("number", F.col("row")[text_col].alias(text_col)).alias("row"))
    parts = []
    for block in itertools.chain([first, second], tests):
        bench = send(block)
        parts.append(spill(texts.mapInArrow(scanner(bench, ["number"]), schema(StructType().add("number", "long"))).where(F.lit(not parts) | (F.size("spans") > 0)), "spans"))
        bench.destroy()
    both = functools.reduce(DataFrame.unionByName, parts).select("row.number", "n_words", "spans", "items")
    merged = both.groupBy("number").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    carried = numbered.select("number", F.struct(*[F.col("row")[c].alias(c) for c in kept]).alias("row"))
    return carried.join(merged, "number").select("row", "n_words", merge_spans("spans").alias("spans"), "items")


def merge_spans(spans: str):
    """Sorted spans with overlapping and touching ones joined."""
    kind = "array<struct<lo:bigint,hi:bigint>>"

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["hi"] >= x["lo"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.col(spans), F.array().cast(kind), step)


def hits(spans: DataFrame) -> DataFrame:
    """``spans`` with n_hit (words in a span), n_items and contaminated (a twentieth of the words or more are hit)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    return spans.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, most_words: int = 1 << 20, shard_words: int = 1 << 18, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, unchanged otherwise. Each row is judged by its own text."""
    rows = docs.select(F.struct("*").alias("row"))
    found = _found(rows, benchmark, width=width, most_words=most_words, shard_words=shard_words, text_col=text_col, item_col=item_col, item_text_col=item_text_col, kept=docs.columns)
    return hits(found).where("NOT contaminated").select("row.*")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = hits(find_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, greatest(1, len(w) - 12))) AS k FROM b WHERE len(w) > 0)),
dk AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS k FROM d),
h AS (SELECT doc_id, k, bw.n, item_id FROM dk, (SELECT DISTINCT n FROM bw) ns, bw
      WHERE k + ns.n - 1 <= len(w) AND bw.n = ns.n AND bw.g = array_to_string(w[k:k + ns.n - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS x FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
