"""Vectorised byte work on Arrow text columns: blocks of whole documents, words, and 64-bit hashes.

A block is a flat uint8 array with the start and end of each document in it. Nulls are
empty documents. Only A-Z is lower-cased, so results do not depend on a locale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: [\x20\x09-\x0D]
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: [\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z has become a-z, so A-Z are letters here
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        k, step = 1, base
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(step)
            step = step * step % 2**64
            k *= 2
        _powers[base] = have
    return have[:n]


@dataclass
class Block:
    """Whole documents: ``data[starts[i]:ends[i]]`` is document ``row0 + i`` of the batch."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row0: int

    def __len__(self) -> int:
        return len(self.starts)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string or binary column, without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_binary()), True
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    return data, starts, ends


def blocks(column, most_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column as blocks of about ``most_bytes``; a document is never split, so a longer one is a block by itself."""
    data, starts, ends = flat(column)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most_bytes, "right")))
        base = int(starts[i])
        yield Block(data[base : int(ends[j - 1])] if ends[j - 1] > base else data[:0], starts[i:j] - base, np.maximum(ends[i:j] - base, starts[i:j] - base), i)
        i = j


@dataclass
class Words:
    """Word k is ``data[start[k]:end[k]]``; those of document d have numbers lo[d] to hi[d]-1."""

    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def words(block: Block, separators: np.ndarray) -> Words:
    data = block.data
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        none = np.zeros(len(block), np.int64)
        return Words(zero, zero, none, none.copy())
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[block.starts] = True
    edge[block.ends] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside
    tail = last.copy()
    tail[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(tail) + 1
    return Words(start, end, np.searchsorted(start, block.starts), np.searchsorted(start, block.ends))


def word_hashes(block: Block, w: Words, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word that depends on its bytes alone (A-Z as a-z)."""
    if len(w.start) == 0:
        return np.zeros(0, np.uint64)
    value = _BYTE_VALUE[LOWER[block.data]] if lower else _BYTE_VALUE[block.data]
    n = len(value)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * powers(n), out=sums[1:])
    inverse = pow(_BASE, -1, 2**64)
    h = (sums[w.end] - sums[w.start]) * powers(n, inverse)[w.start]
    return mix64(h + (w.end - w.start).astype(np.uint64))


def shingle_hashes(h: np.ndarray, w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles in order, and their document's number; a shorter, non-empty document is one shingle."""
    counts = w.hi - w.lo
    per_doc = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), per_doc)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + np.repeat(w.lo, per_doc)
    left = np.repeat(counts, per_doc)
    out = np.zeros(len(doc), np.uint64)
    for k in range(width):
        has = left > k if width > 1 else slice(None)
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(has, h[np.minimum(at + k, max(len(h) - 1, 0))], np.uint64(0)) if len(h) else out
    out = mix64(out + np.minimum(left, width).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return out, doc
