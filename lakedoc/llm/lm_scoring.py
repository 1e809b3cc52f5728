"""Subword lattice likelihood.

An existing subword vocabulary spans a lattice over each word: every way to cut it into pieces is a
path, weighted by the product of its pieces' probabilities. A forward recursion in log space
sums all paths, which gives the word's marginal probability; a document's is the product over its
words and one end. Where the vocabulary file holds log probabilities (a unigram model), they are the pieces' scores as they
stand. Where it holds merge ranks, these start as a Zipf law and probabilities are re-estimated on the training
documents by two rounds of expected counts over all segmentations (forward-backward), as ranks alone
are no likelihoods; ``rounds`` sets another number. Nothing is segmented greedily.

Words are counted over all documents first, so each distinct word's lattice is summed once, however
often it stands in the corpus. A word with at least 1 in ``head_share`` of the training tokens goes into a
broadcast table, which thus has at most ``head_share`` rows; all other words are joined by key.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; pieces never cross words; bytes are pieces too, so every
text has a probability. The vocabulary is read on the driver from ``vocabulary``, a path.

Defined cases: null and empty texts have one token, the end; a null id is not held out; repeated rows are
scored and counted each; without training documents every count is 0 and pieces keep their first
probabilities; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 256  # the code that begins each word; bytes are 0 to 255
_BASE = np.uint64(0x9E3779B97F4A7C15)
LONG = 64  # words of more codes are summed one by one
CHUNK = 1 << 14  # places of such a word whose pieces are held at a time
END = b""  # the key of the end in tables of words, which are never empty


@dataclass
class Pieces:
    """Pieces as hashes of their codes, sorted, with log probabilities, and that of the end."""

    hashes: np.ndarray
    logp: np.ndarray
    longest: int
    end: float = 0.0
    ranked: bool = False  # the scores come from merge ranks

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def __reduce__(self):
        return Pieces, (self.hashes, self.logp, self.longest, self.end, self.ranked)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are pieces, and which."""
        rows = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[rows]), len(self.hashes) - 1)
        ok = self.hashes[at] == h[rows]
        return rows[ok], at[ok]


def _hash(codes: list[int]) -> int:
    h = 0
    for c in codes:
        h = (h * int(_BASE) + c + 1) % 2**64
        h ^= h >> 29
    return h


def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = h * _BASE + (codes.astype(np.uint64) + np.uint64(1))
    return h ^ (h >> np.uint64(29))


def load_pieces(vocabulary: str = VOCABULARY) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found: dict[tuple[int, ...], float] = {(b,): -math.inf for b in (*range(256), MARK)}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k):
            continue
        piece, score = model.id_to_piece(k), model.get_score(k)
        head, tail = ([MARK], piece[1:]) if piece[0] == "▁" else ([], piece)
        if "▁" in tail or score < -1e8:
            continue
        codes = (*head, *tail.encode())
        found[codes] = max(found.get(codes, -math.inf), score)
    scores = np.array(list(found.values()))
    known = np.isfinite(scores)
    ranked = bool(known.any() and np.all(scores[known] == np.round(scores[known])))  # merge ranks, not logarithms
    if ranked:
        scores[known] = -np.log(2.0 - scores[known])
    scores[~known] = (scores[known].min() if known.any() else 0.0) - 1.0
    logp = scores - np.logaddexp.reduce(scores)
    hashes = np.array([_hash(list(c)) for c in found], np.uint64)
    order = np.argsort(hashes)
    return Pieces(hashes[order], logp[order], max(map(len, found)), ranked=ranked)


def _codes(words: list[bytes], length: int) -> np.ndarray:
    out = np.full((len(words), length), MARK, np.uint16)
    out[:, 1:] = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length - 1)
    return out


def forward(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, list]:
    """Log-space forward sums of words of one length, [word, position], and the arcs (from, to, words, pieces)."""
    n, length = codes.shape
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0
    arcs = []
    for i in range(length):
        h = np.zeros(n, np.uint64)
        for j in range(i + 1, min(length, i + pieces.longest) + 1):
            h = _step(h, codes[:, j - 1])
            rows, which = pieces.find(h)
            if len(rows):
                alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + pieces.logp[which])
                arcs.append((i, j, rows, which))
    return alpha, arcs


def expected(codes: np.ndarray, weight: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected uses of each piece over all segmentations, words weighted by their counts."""
    alpha, arcs = forward(codes, pieces)
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0
    uses, which = [], []
    for i, j, rows, k in reversed(arcs):
        onward = pieces.logp[k] + beta[j, rows]
        beta[i, rows] = np.logaddexp(beta[i, rows], onward)
        uses.append(np.exp(alpha[i, rows] + onward - alpha[-1, rows]) * weight[rows])
        which.append(k)
    return np.bincount(np.concatenate(which), np.concatenate(uses), len(pieces.logp))


def _arcs(codes: np.ndarray, pieces: Pieces, lo: int, hi: int, by_end: bool) -> Iterator[tuple[int, list[int], list[int]]]:
    """Pieces in one long word that end in (lo, hi], or start in [lo, hi): each such place in order, and the other ends and the pieces there."""
    a = max(0, lo - pieces.longest + 1) if by_end else lo
    b = hi if by_end else min(len(codes), hi + pieces.longest - 1)
    part = codes[a:b]
    starts, ends, which = [], [], []
    h = np.zeros(len(part), np.uint64)
    for k in range(min(pieces.longest, len(part))):
        h = _step(h[: len(part) - k], part[k:])
        rows, found = pieces.find(h)
        starts.append(rows + a)
        ends.append(rows + (a + k + 1))
        which.append(found)
    starts, ends, which = np.concatenate(starts), np.concatenate(ends), np.concatenate(which)
    here, there = (ends, starts) if by_end else (starts, ends)
    inside = (here > lo) & (here <= hi) if by_end else (here >= lo) & (here < hi)
    order = np.flatnonzero(inside)[np.argsort(here[inside], kind="stable")]
    here, there, which = here[order], there[order], which[order]
    edges = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]])) if len(here) else np.zeros(0, np.int64)
    for x, y in zip(edges.tolist(), [*edges[1:].tolist(), len(here)], strict=True) if len(edges) else ():
        yield int(here[x]), there[x:y].tolist(), which[x:y].tolist()


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(x - top) for x in terms)) if len(terms) > 1 else top


def long_forward(codes: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Log-space forward sums of one word, by position; its pieces are found for ``CHUNK`` places at a time."""
    logp = pieces.logp
    alpha = [0.0] + [-math.inf] * len(codes)
    for lo in range(0, len(codes), CHUNK):
        for j, starts, which in _arcs(codes, pieces, lo, min(len(codes), lo + CHUNK), True):
            alpha[j] = _log_sum([alpha[i] + p for i, p in zip(starts, logp[which].tolist(), strict=True)])
    return np.array(alpha)


def long_expected(codes: np.ndarray, weight: float, pieces: Pieces) -> np.ndarray:
    logp = pieces.logp
    alpha = long_forward(codes, pieces).tolist()
    n = len(codes)
    beta = [-math.inf] * n + [0.0]
    out = np.zeros(len(logp))
    for lo in range((n - 1) // CHUNK * CHUNK, -1, -CHUNK):
        places = list(_arcs(codes, pieces, lo, min(n, lo + CHUNK), False))
        for i, ends, which in reversed(places):
            onward = [beta[j] + p for j, p in zip(ends, logp[which].tolist(), strict=True)]
            beta[i] = _log_sum(onward)
            for k, x in zip(which, onward, strict=True):
                out[k] += math.exp(alpha[i] + x - alpha[n]) * weight
    return out


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Places of words of each length in codes, in groups of at most 16,384."""
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        for at in range(0, len(group), 1 << 14):
            if len(part := group[at : at + (1 << 14)]):
                yield int(lengths[part[0]]), part


def word_logp(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Marginal log probability of each word."""
    out = np.zeros(len(words))
    for length, at in _by_length(words):
        if length > LONG:
            for k in at:
                out[k] = long_forward(_codes([words[k]], length)[0], pieces)[-1]
        else:
            out[at] = forward(_codes([words[k] for k in at], length), pieces)[0][-1]
    return out


def expected_uses(words: list[bytes], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    out = np.zeros(len(pieces.logp))
    for length, at in _by_length(words):
        if length > LONG:
            for k in at:
                out += long_expected(_codes([words[k]], length)[0], float(counts[k]), pieces)
        else:
            out += expected(_codes([words[k] for k in at], length), counts[at], pieces)
    return out


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Batches joined to tables of ``rows`` rows, so that words of each length come in large groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, train) to partial counts (word, count in training texts), in bounded memory."""
    taught: Counter = Counter()
    other: set[bytes] = set()

    def flush() -> pa.RecordBatch:
        words = [*taught, *(w for w in other if w not in taught)]
        counts = [*taught.values(), *[0] * (len(words) - len(taught))]
        taught.clear()
        other.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "c"])

    for batch in batches:
        for text, train in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (text or b"").lower().split()
            if train:
                taught.update(words)
                taught[END] += 1
            else:
                other.update(words)
            if len(taught) + len(other) > 400_000:
                yield flush()
    if taught or other:
        yield flush()


def _base(c: int, n: int, v: int) -> float:
    return math.log10((c + 0.1) / (n + 0.1 * (v + 1)))


def score_documents(docs: DataFrame, *, vocabulary: str = VOCABULARY, folds: int = 10, rounds: int | None = None, head_share: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    ``score``: log10 of the document's marginal probability; ``base_score``: of its words as whole units with
    added 0.1. Documents whose crc32(id as text) is divisible by ``folds`` are held out of both.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    texts = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = texts.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_count_words, "word binary, c long")
    words = cut(counts.groupBy("word").agg(F.sum("c").alias("c")))
    n, v, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))).first()

    pieces = load_pieces(vocabulary)
    total = max(float(n - ends), 1.0)  # without re-estimation, the end's share is taken among words
    rounds = rounds if rounds is not None else 2 * pieces.ranked
    for _ in range(rounds if n else 0):
        model = spark.sparkContext.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            pieces = model.value
            uses = np.zeros(len(pieces.logp))
            for table in _gathered(batches):
                uses += expected_uses(table.column("word").to_pylist(), table.column("c").to_numpy().astype(float), pieces)
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(uses[at], pa.float64())], names=["piece", "uses"])

        rows = words.where("c > 0 AND octet_length(word) > 0").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # a row a piece at most
        uses = np.full(len(pieces.logp), 0.1)
        for r in rows:
            uses[r["piece"]] += r["uses"]
        total = float(uses.sum())
        pieces = Pieces(pieces.hashes, np.log(uses / total), pieces.longest)
    pieces = Pieces(pieces.hashes, pieces.logp + math.log(total / (total + ends + 0.1)), pieces.longest, math.log((ends + 0.1) / (total + ends + 0.1)))
    model = spark.sparkContext.broadcast(pieces)

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            held = table.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), table.column("c").combine_chunks(), pa.array(word_logp(held, model.value), pa.float64())], names=["word", "c", "logp"])

    scored = cut(words.where("octet_length(word) > 0").mapInArrow(marginals, "word binary, c long, logp double"))
    common = scored.where((F.col("c") * head_share >= n) & (F.col("c") > 0) & (F.octet_length("word") <= 64))  # at most head_share words
    head = spark.sparkContext.broadcast({bytes(r["word"]): (_base(r["c"], n, v), r["logp"]) for r in common.toLocalIterator()})
    end = _base(ends, n, v)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ended = head.value, model.value.end
        pair = pa.struct([("word", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sums, rest = [], []
                for text in part.column(3).cast(pa.binary()).to_pylist():
                    uses = Counter((text or b"").lower().split())
                    base, logp, known = end, ended, int(ends > 0)
                    tail = []
                    for word, n in uses.items():
                        if (hit := table.get(word)) is not None:
                            base += n * hit[0]
                            logp += n * hit[1]
                            known += n
                        else:
                            tail.append({"word": word, "n": n})
                    sums.append((uses.total() + 1, known, base, logp))
                    rest.append(tail)
                columns = [pa.array(c, t) for c, t in zip(zip(*sums, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(3)], *columns, pa.array(rest, pa.list_(pair))], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "logp", "tail"])

    partial = cut(texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(add, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, logp double, tail array<struct<word:binary,n:long>>"))
    tail = partial.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n").join(scored, "word")
    tail = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known2"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / F.lit(n + 0.1 * (v + 1)))).alias("base2"),
        F.sum(F.col("n") * F.col("logp")).alias("logp2"),
    )
    both = partial.drop("tail").join(tail, "row", "left")
    return both.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        ((F.col("logp") + F.coalesce("logp2", F.lit(0.0))) / math.log(10)).alias("score"),
    )


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
