"""Document quality by a linear-chain conditional random field over lines.

Every non-blank line is good or bad. Its potentials come from features of the line and of
the lines before and after; transitions link neighbours. The forward-backward algorithm gives
each line's marginal probability of being good, and a document's quality is the mean of
its lines' marginals, weighted by their length in bytes.

The field is fitted by gradient ascent on a bounded sample: at most ``max_docs`` labelled documents of each
label, the ones with the smallest hash of the id, and of each at most ``max_lines`` consecutive lines that begin at a place
given by that hash, anywhere in the document; every line takes its document's label. Scoring covers all lines of all
documents; a task holds a whole document's features, about 3 KB a line.

Defined cases: texts without a non-blank line (null and empty ones too) score the share of
good documents in the sample; without labels that is 0.5 and all documents get it; several labels of a
document are averaged and null labels ignored; a null id is not held out; repeated rows are
scored each; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import WHITE, Block, blocks, word_hashes, words

#: Features of a line by itself; those of the line before and after follow.
OWN = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "runs_of_marks", "pipes", "blanks", "repeats", "same_words", "ends_sentence", "capital_words", "braces", "seen_line", "long_words")
N_FEATURES = 3 * len(OWN) + 1


@dataclass
class Model:
    """Weights of the good state by feature, transition potentials [from, to], feature means and scales, and the prior."""

    weights: np.ndarray
    transitions: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float


@dataclass
class Lines:
    """Non-blank lines of a block: features, bytes, and for each document its range of lines."""

    x: np.ndarray
    size: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_UPPER = _class(bytes(range(65, 91)))
_DIGIT = _class(b"0123456789")
_MARK = _class(bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-?!()"))
_PIPE = _class(b"|")
_END = _class(b".!?\"'")
_BRACE = _class(b"{}<>=;_/\\")
_FEED = _class(b"\n")


def lines_of(block: Block) -> Lines:
    data = block.data
    parts = words(block, _FEED)  # a line is a run without line feeds
    w = words(block, WHITE)
    first, last = np.searchsorted(w.start, parts.start), np.searchsorted(w.start, parts.end)
    keep = last > first
    line_doc = np.repeat(np.arange(len(block)), parts.hi - parts.lo)[keep]
    start, end, first, last = parts.start[keep], parts.end[keep], first[keep], last[keep]
    lo, hi = np.searchsorted(line_doc, np.arange(len(block))), np.searchsorted(line_doc, np.arange(len(block)), "right")
    n = len(start)
    if not n:
        return Lines(np.zeros((0, N_FEATURES)), np.zeros(0), lo, hi)

    def total(flags: np.ndarray, a=start, b=end) -> np.ndarray:
        sums = np.zeros(len(flags) + 1)
        np.cumsum(flags, out=sums[1:])
        return sums[b] - sums[a]

    size, count = (end - start).astype(float), (last - first).astype(float)
    h = word_hashes(block, w)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[first] = False
    long = (w.end - w.start) > 14
    marks = _MARK[data]
    run = np.zeros(len(data), bool)
    run[1:] = marks[1:] & marks[:-1]
    capital = _UPPER[data[w.start]]
    lead = h[np.minimum(first, len(h) - 1)]
    # distinct words: equal neighbours after sorting words within lines
    line_word = np.repeat(np.arange(n), last - first)
    pick = np.concatenate([np.zeros(0, np.int64), np.arange(len(line_word)) + np.repeat(first - (np.cumsum(last - first) - (last - first)), last - first)])
    order = np.lexsort((h[pick], line_word))
    hs, ls = h[pick][order], line_word[order]
    dup = np.zeros(len(hs), bool)
    dup[1:] = (hs[1:] == hs[:-1]) & (ls[1:] == ls[:-1])
    same = np.bincount(ls, dup, n)
    # a line seen before in its document: equal digest of all words
    digest = np.bincount(line_word, (h[pick] >> np.uint64(20)).astype(float), n) + count + lead.astype(float) * 1e-3
    seen = np.zeros(n)
    by = np.lexsort((digest, line_doc))
    seen[by[1:]] = (digest[by][1:] == digest[by][:-1]) & (line_doc[by][1:] == line_doc[by][:-1])
    own = np.stack(
        [
            np.log1p(size), np.log1p(count), (size - count) / count, total(_UPPER[data]) / size, total(_DIGIT[data]) / size, total(marks) / size, total(run) / count, total(_PIPE[data]) / count, total(WHITE[data]) / size,
            total(again, first, last) / count, same / count, _END[data[end - 1]].astype(float), total(capital, first, last) / count, total(_BRACE[data]) / size, seen, total(long, first, last) / count,
        ],
        1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = np.flatnonzero(line_doc[1:] == line_doc[:-1])
    before[inner + 1], after[inner] = own[inner], own[inner + 1]
    return Lines(np.concatenate([own, before, after, np.ones((n, 1))], 1), size, lo, hi)


def marginals(scores: np.ndarray, transitions: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions summed over all chains, and the log partition sum.

    ``scores``: the good state's potential by line (the bad one's is 0). Chains are lines lo[d] to hi[d]-1.
    All chains step together; those that are shorter drop out.
    """
    n = len(scores)
    potential = np.stack([np.zeros(n), scores], 1)
    order = np.argsort(lo - hi, kind="stable")
    order = order[hi[order] > lo[order]]
    start, length = lo[order], (hi - lo)[order]
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(length.max(initial=0))
    alive = np.searchsorted(-length, -np.arange(longest), "left")  # chains longer than t
    for t in range(longest):
        at = start[: alive[t]] + t
        if t == 0:
            alpha[at] = potential[at]
        else:
            past = alpha[at - 1]
            alpha[at] = np.logaddexp(past[:, :1] + transitions[0], past[:, 1:] + transitions[1]) + potential[at]
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        onward = beta[at + 1] + potential[at + 1]
        beta[at] = np.logaddexp(transitions[:, 0] + onward[:, :1], transitions[:, 1] + onward[:, 1:])
    z = np.logaddexp(alpha[:, 0] + beta[:, 0], alpha[:, 1] + beta[:, 1])
    good = np.exp(alpha[:, 1] + beta[:, 1] - z)
    to = np.concatenate([np.zeros(0, np.int64), *[start[: alive[t]] + t for t in range(1, longest)]])
    joint = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            joint[a, b] = np.exp(alpha[to - 1, a] + transitions[a, b] + potential[to, b] + beta[to, b] - z[to]).sum()
    return good, joint, float(z[start].sum())


def fit(x: np.ndarray, label: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, prior: float, steps: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> Model:
    """Weights by Adam on the conditional log likelihood of line labels; ``weight`` balances the labels' documents."""
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale = 0.0, np.where(scale > 1e-9, scale, 1.0)
    x = (x - mean) / scale
    chain = np.repeat(np.arange(len(lo)), hi - lo)
    first = np.zeros(len(x), bool)
    first[lo[hi > lo]] = True
    to = np.flatnonzero(~first)
    total = float((weight * (hi - lo)).sum())
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gradient = np.zeros_like(theta)
        for value in np.unique(weight):  # chains of one weight together, for the expected transitions
            mine = weight == value
            good, joint, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), lo[mine], hi[mine])
            lines = mine[chain]
            gradient[:-4] += value * (x[lines].T @ (label[lines] - good[lines]))
            pairs = to[lines[to]]
            seen = np.bincount((2 * label[pairs - 1] + label[pairs]).astype(int), minlength=4)
            gradient[-4:] += value * (seen - joint.ravel())
        gradient = gradient / total - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2), mean, scale, prior)


def _line_rows(max_lines: int):
    """(at, label, text) to the label and packed features of consecutive lines of each document, from a place that ``at`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                lines = lines_of(block)
                place = np.asarray(batch.column(0).slice(block.row0, len(block))) % np.maximum(lines.hi - lines.lo - max_lines + 1, 1)
                packed = [lines.x[a + p : min(b, a + p + max_lines)].astype(np.float32).tobytes() for a, b, p in zip(lines.lo, lines.hi, place, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(block.row0, len(block)), pa.array(packed, pa.binary())], names=["label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = 2000, max_lines: int = 100, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A field fitted on documents of ``docs`` that ``labels`` (doc_id, quality) marks."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = marked.join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("at", F.xxhash64("doc_id"))
    picked = [chosen.where(F.col("label") == k).orderBy("at", "doc_id").limit(max_docs) for k in (0, 1)]
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("at", "label", "text")
    rows = [(r["label"], np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, N_FEATURES)) for r in sample.mapInArrow(_line_rows(max_lines), "label int, x binary").collect()]
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5)
    label_of = np.array([r[0] for r in rows])
    prior = float(label_of.mean())
    sizes = np.array([len(r[1]) for r in rows])
    hi = np.cumsum(sizes)
    weight = np.where(label_of == 1, 0.5 / max((label_of == 1).sum(), 1), 0.5 / max((label_of == 0).sum(), 1)) * len(rows)
    return fit(np.concatenate([r[1] for r in rows]).astype(float), np.repeat(label_of, sizes).astype(float), hi - sizes, hi, weight, prior)


def document_scores(block: Block, model: Model) -> tuple[np.ndarray, np.ndarray, Lines]:
    """Quality by document, P(good) by line, and the lines."""
    lines = lines_of(block)
    good, _, _ = marginals((lines.x - model.mean) / model.scale @ model.weights, model.transitions, lines.lo, lines.hi)
    sums, mass = np.zeros(len(good) + 1), np.zeros(len(good) + 1)
    np.cumsum(good * lines.size, out=sums[1:])
    np.cumsum(lines.size, out=mass[1:])
    weight = mass[lines.hi] - mass[lines.lo]
    score = np.where(weight > 0, (sums[lines.hi] - sums[lines.lo]) / np.maximum(weight, 1), model.prior)
    return np.clip(score, 0.0, 1.0), good, lines


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, quality (0 to 1), n_lines and n_good_lines for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                quality, good, lines = document_scores(block, shared.value)
                fine = np.concatenate([[0], np.cumsum(good >= 0.5)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row0, len(block)), pa.array(quality), pa.array(lines.hi - lines.lo, pa.int64()), pa.array(fine[lines.hi] - fine[lines.lo], pa.int64())], names=["id", "quality", "n_lines", "n_good_lines"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, quality double, n_lines long, n_good_lines long").withColumnRenamed("id", id_col)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train(docs.where(~held), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", held.alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_good_lines")
