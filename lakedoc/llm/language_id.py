"""Language identification by error-correcting output codes.

Each language has a codeword of signs; each bit of it has a binary classifier over hashed byte
n-grams (two to four bytes, A-Z in lower case, ASCII non-letters as one blank): the log odds of an n-gram in
the languages on either side, from counts over all training documents. A text's bit is its
mean log odds, centred and scaled by what training texts give; decoding takes the codeword
with the least loss, each bit weighted by how well it separates. Ambiguous are texts
whose two nearest codewords are close, or whose bits lie beyond what the code corrects.

Up to seven languages get the exhaustive code, more get dense words of fixed signs. Counts are
aggregated by language and bucket, and turned into weights of bits by Spark's tasks, each for its own buckets. So any number of
languages is learned: what reaches the driver is the model, 65,536 buckets x bits (about ten times the logarithm of
the number of languages), and the languages' names. Memory for a text is a fixed part and about 30 bytes a byte.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any training
text all are ``und``; with one language all others are that language with score 1; null languages are
not learned from; a null id is not held out; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard
from .textblocks import LOWER, Block, blocks, mix64

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
UNKNOWN = "und"

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


@dataclass
class Model:
    """languages; codewords [language, bit]; weights [bucket or none, bit]; centre, scale and reliability by bit."""

    languages: list[str]
    codewords: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    reliability: np.ndarray


def ngram_buckets(block: Block) -> Iterator[np.ndarray]:
    """For each n, the bucket of the n-gram at each byte; BUCKETS where it would cross the text's end or spans two blanks."""
    text = _FOLD[block.data]
    n = len(text)
    left = np.zeros(n, np.int32)
    for a, b in zip(block.starts, block.ends, strict=True):
        left[a:b] = np.minimum(np.arange(b - a, 0, -1), 9)
    blank = text == 0x20
    double = np.zeros(n, bool)
    double[:-1] = blank[:-1] & blank[1:]
    h = text.astype(np.uint32)
    bad = np.zeros(n, bool)
    for size in range(2, max(SIZES) + 1):
        k = size - 1
        h = h * np.uint32(0x01000193)
        h[: max(n - k, 0)] ^= text[k:]
        bad[: max(n - k + 1, 0)] |= double[k - 1 :]
        if size in SIZES:
            bucket = ((h * np.uint32(0x9E3779B1) + np.uint32(size * 0x7F4A7C15 % 2**32)) >> np.uint32(16)).astype(np.int32)
            bucket[bad | (left < size)] = BUCKETS
            yield bucket


def codewords(n_languages: int) -> np.ndarray:
    """Signs by language and bit: all splits of the languages up to seven, else fixed dense words."""
    if n_languages <= 1:
        return np.ones((n_languages, 1))
    if n_languages <= 7:
        splits = range(1, 2 ** (n_languages - 1))
        return np.array([[1.0 if k == n_languages - 1 or not s >> k & 1 else -1.0 for s in splits] for k in range(n_languages)])
    n_bits = math.ceil(10 * math.log2(n_languages))
    best, rows = None, np.arange(n_languages)
    for seed in range(20):
        raw = mix64(np.arange(n_languages * n_bits, dtype=np.uint64) + np.uint64(seed * 1_000_003))
        signs = np.where(raw.reshape(n_languages, n_bits) >> np.uint64(63), 1.0, -1.0)
        signs = signs[:, np.abs(signs.sum(0)) < n_languages]
        same = signs @ signs.T
        same[rows, rows] = -np.inf
        apart = (signs.shape[1] - same.max()) / 2
        if best is None or apart > best[0]:
            best = (apart, signs)
    return best[1]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, bucket, n)."""
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), object)
        for block in blocks(batch.column(1)):
            names, code = np.unique(languages[block.row0 : block.row0 + len(block)].astype(str), return_inverse=True)
            of_byte = np.zeros(len(block.data), np.int64)
            for a, b, c in zip(block.starts, block.ends, code, strict=True):
                of_byte[a:b] = c
            for bucket in ngram_buckets(block):
                keys, n = np.unique(of_byte * (BUCKETS + 1) + bucket, return_counts=True) if len(names) > 8 else _dense(of_byte, bucket, len(names))
                cuts = np.searchsorted(keys, np.arange(len(names) + 1) * (BUCKETS + 1))
                for name, a, b in zip(map(str, names), cuts[:-1], cuts[1:], strict=True):
                    if name not in held:
                        if len(held) >= 32:
                            yield from flush()
                        held[name] = np.zeros(BUCKETS + 1, np.int64)
                    held[name][keys[a:b] % (BUCKETS + 1)] += n[a:b]
    yield from flush()


def _dense(of_byte: np.ndarray, bucket: np.ndarray, n_names: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.bincount(of_byte * (BUCKETS + 1) + bucket, minlength=n_names * (BUCKETS + 1))
    keys = np.flatnonzero(found)
    return keys, found[keys]


def _weights(names: list[str], totals: np.ndarray, signs: np.ndarray):
    """(lang, bucket, n), all rows of a bucket in one task, to (bucket, log odds by bit) and one row (-1, sums of odds by side and bit)."""
    place = {name: k for k, name in enumerate(names)}
    mass = totals + 0.5 * BUCKETS
    sides = [((signs > 0) / (signs > 0).sum(0)), ((signs < 0) / (signs < 0).sum(0))]  # [language, bit]: the share of each language in its side's mean
    # a bucket that no text holds has the same share in all languages
    floor = [(0.5 / mass) @ side for side in sides]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, dict[int, int]] = {}
        for batch in batches:
            for lang, bucket, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                counts.setdefault(bucket, {})[place[lang]] = n
        means = np.zeros((2, signs.shape[1]))
        rows = []
        for bucket, held in counts.items():
            at = np.fromiter(held, np.int64, len(held))
            extra = np.fromiter(held.values(), float, len(held)) / mass[at]
            yes, no = (f + extra @ side[at] for f, side in zip(floor, sides, strict=True))
            odds = np.log(yes) - np.log(no)
            means += np.stack([yes * odds, no * odds])
            rows.append(odds)
        yield pa.RecordBatch.from_arrays([pa.array([*counts, -1], pa.int32()), pa.array([*map(list, rows), means.ravel().tolist()], pa.list_(pa.float64()))], names=["bucket", "odds"])

    return run, floor


def train(texts: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Bit classifiers from all rows of ``texts`` that have a language."""
    rows = texts.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = cut(rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: 0 for r in rows.select("lang").distinct().collect()} | {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    signs = codewords(len(names))
    if len(names) < 2:
        return Model(names, signs, np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(1), np.ones(1), np.ones(1))
    run, floor = _weights(names, np.array([totals[x] for x in names], float), signs)
    odds = np.log(floor[0]) - np.log(floor[1])
    weights = np.zeros((BUCKETS + 1, signs.shape[1]), np.float32)
    weights[:BUCKETS] = odds
    means, missing = np.zeros((2, signs.shape[1])), BUCKETS
    for r in counted.repartition("bucket").mapInArrow(run, "bucket int, odds array<double>").toLocalIterator():
        if r["bucket"] < 0:
            means += np.array(r["odds"]).reshape(2, -1)
        else:
            weights[r["bucket"]] = r["odds"]
            missing -= 1
    means += missing * np.stack([floor[0] * odds, floor[1] * odds])
    discard(counted)
    scale = np.maximum((means[0] - means[1]) / 2, 1e-9)
    return Model(names, signs, weights, means.mean(0), scale, scale / scale.mean())


def decode(bits: np.ndarray, n: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language numbers, scores, gaps to the second, and how many bits differ from the codeword, from centred mean log odds."""
    trust = np.sqrt(np.clip(n, 1, 400))[:, None]
    z = (bits - model.centre) / model.scale * trust
    loss = np.stack([(np.logaddexp(0, -z * word) * model.reliability).sum(1) / len(word) for word in model.codewords], 1)
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    rows = np.arange(len(best))
    share = np.exp(loss[rows, best][:, None] - loss)
    gap = loss[rows, order[:, 1]] - loss[rows, best] if loss.shape[1] > 1 else np.full(len(best), np.inf)
    wrong = (np.where(z >= 0, 1.0, -1.0) != model.codewords[best]).sum(1)
    return best, 1 / share.sum(1), gap, wrong


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _bit_sums(weights: np.ndarray, bucket: np.ndarray, starts: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Summed weights of the documents that begin at ``starts``. A block longer than ``step`` is one document, and is summed in parts."""
    if len(bucket) <= step:
        return np.add.reduceat(weights[bucket], starts, axis=0, dtype=np.float64)
    return sum(weights[bucket[a : a + step]].sum(0, dtype=np.float64) for a in range(0, len(bucket), step))[None]


def _identified(docs: DataFrame, model: Model, *, text_col: str, least_gap: float) -> DataFrame:
    """``row`` (all columns of ``docs``), lang_pred, lang_score and lang_ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"))  # the text goes to Python once, within its row
    schema = rows.select("row").schema.add("lang_pred", "string").add("lang_score", "double").add("lang_ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        signs = model.codewords
        corrected = (int((signs.shape[1] - max((signs @ signs.T)[np.triu_indices(len(signs), 1)])) / 2) - 1) // 2 if len(signs) > 1 else 0
        for batch in batches:
            texts = batch.column(0).field(text_col)
            for block in blocks(texts, 1 << 18):
                n_bits = signs.shape[1] if len(signs) else 1
                sums, n = np.zeros((len(block), n_bits)), np.zeros(len(block))
                full = np.flatnonzero(block.ends > block.starts)
                if len(full) and len(signs):
                    for bucket in ngram_buckets(block):
                        sums[full] += _bit_sums(model.weights, bucket, block.starts[full])
                        n[full] += np.add.reduceat((bucket < BUCKETS).astype(np.int64), block.starts[full])
                held = texts.slice(block.row0, len(block)).to_pylist()
                ok = np.array([has_letter(t) for t in held], bool) & bool(len(signs))
                names, scores, doubt = [UNKNOWN] * len(block), np.zeros(len(block)), np.zeros(len(block), bool)
                if ok.any():
                    best, score, gap, wrong = decode(sums[ok] / np.maximum(n[ok], 1)[:, None], n[ok], model)
                    scores[ok] = score
                    doubt[ok] = (gap < least_gap) | (wrong > corrected)
                    for k, b in zip(np.flatnonzero(ok), best, strict=True):
                        names[k] = model.languages[b]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row0, len(block)), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_())], names=["row", "lang_pred", "lang_score", "lang_ambiguous"])

    return rows.mapInArrow(run, schema)


ADDED = ("lang_pred", "lang_score", "lang_ambiguous")


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", least_gap: float = 0.2) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_ambiguous, which replace columns of those names."""
    return _identified(docs, model, text_col=text_col, least_gap=least_gap).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def held_out(id_col: str, folds: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def drop_unidentified(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", folds: int = 5) -> DataFrame:
    """``docs`` without rows of no language: no letter, or a decoding that is ambiguous with a score under one half."""
    model = train(docs.where(~held_out(id_col, folds)), lang_col=lang_col, text_col=text_col)
    found = _identified(docs, model, text_col=text_col, least_gap=0.2)
    return found.where((F.col("lang_pred") != UNKNOWN) & ~(F.col("lang_ambiguous") & (F.col("lang_score") < 0.5))).select("row.*")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id", 5)))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_ambiguous")
