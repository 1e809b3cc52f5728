"""Signature sniffing of media columns.

An Aho-Corasick automaton finds all magic bytes of a blob in one pass; at each hit a validator of
that format walks its structure (chunks, markers, blocks, boxes) and gives the exact
length, or none. The first valid object decides the true type, whatever was declared, and
valid objects are carved out by offset and length; one that lies within another is part of it. FLAC is not among
the formats, as its frames tell no length and only decoding them would.

Defined cases: a null or empty blob has no objects and the type ``application/octet-stream`` with
length 0; a blob of text without objects is ``text/plain`` if it is UTF-8 without NUL; truncated objects
are not objects; equal blobs give equal rows; an empty table gives no rows; only the
named columns are read, so others may have any names.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructField, StructType


def _png(b: bytes, at: int) -> int | None:
    p, seen = at + 8, b""
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        kind, end = b[p + 4 : p + 8], p + 12 + n
        if end > len(b) or (not seen and (kind, n) != (b"IHDR", 13)) or zlib.crc32(b[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        seen, p = kind, end
        if kind == b"IEND":
            return p - at
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p = at + 2
    scanned = False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        m = b[p + 1]
        if m == 0xD9:
            return p + 2 - at if scanned else None
        if m == 0xFF:
            p += 1
            continue
        if 0xD0 <= m <= 0xD7 or m == 0x01:
            p += 2
            continue
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2:
            return None
        p += 2 + n
        if m == 0xDA:  # entropy-coded data up to a marker that isn't stuffing or a restart
            scanned = True
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return p + 2 - at if scanned and b[p : p + 2] == b"\xff\xd9" else None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    images = 0
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at if images else None
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            images += 1
            p = blocks(p + 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1)
        else:
            return None
    return None


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b):
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    p, kinds = at + 12, []
    while p + 8 <= end:
        kinds.append(b[p : p + 4])
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + n + n % 2
    want = {b"WAVE": {b"fmt ", b"data"}, b"WEBP": {b"VP8 ", b"VP8L", b"VP8X"}, b"AVI ": {b"LIST"}}.get(b[at + 8 : at + 12])
    if want is None or p != end or not (want <= set(kinds) if b[at + 8 : at + 12] == b"WAVE" else want & set(kinds)):
        return None
    return end - at


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    if zero or header not in (40, 108, 124) or not 14 + header <= offset <= size or at + size > len(b):
        return None
    w, h, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    return size if planes == 1 and bits in (1, 4, 8, 16, 24, 32) and offset + (w * bits + 31) // 32 * 4 * abs(h) <= size else None


class Ends:
    """Where ZIP archives and PDF files may end in a blob, found in one scan and looked up from then on."""

    def __init__(self, blob: bytes):
        self.blob = blob

    @functools.cached_property
    def zips(self) -> dict[int, int]:
        """The start that an end-of-directory record tells of, and the first end that tells of it."""
        found: dict[int, int] = {}
        b, end = self.blob, self.blob.find(b"PK\x05\x06")
        while 0 <= end and end + 22 <= len(b):
            size, offset = struct.unpack_from("<II", b, end + 12)
            note = int.from_bytes(b[end + 20 : end + 22], "little")
            at = end - size - offset
            if at >= 0 and end + 22 + note <= len(b) and (not size or b[at + offset : at + offset + 4] == b"PK\x01\x02"):
                found.setdefault(at, end + 22 + note)
            end = b.find(b"PK\x05\x06", end + 4)
        return found

    @functools.cached_property
    def pdfs(self) -> dict[int, int]:
        """The start of each PDF file and its end: that of the last trailer whose table lies where it says, counted from the nearest header before it for which that holds."""
        headers = [m.start() for m in re.finditer(rb"%PDF-", self.blob)]
        tables = [m.start() for m in re.finditer(rb"(?<!start)xref\b|\d{1,10}\s{1,4}\d{1,5}\s{1,4}obj\b", self.blob)]
        header_set, table_set = set(headers), set(tables)
        valid: dict[int, list[int]] = {}  # headers by a trailer's offset
        found: dict[int, int] = {}
        for m in re.finditer(rb"startxref\s{1,4}(\d{1,19})\s{1,4}%%EOF", self.blob):
            offset = int(m[1])
            if offset not in valid:
                valid[offset] = [h for h in headers if h + offset in table_set] if len(headers) < len(tables) else sorted(t - offset for t in tables if t - offset in header_set)
            k = bisect.bisect_left(valid[offset], m.start())
            if k and valid[offset][k - 1] + offset < m.start():
                found[valid[offset][k - 1]] = m.end()
        return found


def _zip(b: bytes, at: int, ends: Ends) -> int | None:
    return ends.zips[at] - at if at in ends.zips else None


def _pdf(b: bytes, at: int, ends: Ends) -> int | None:
    return ends.pdfs[at] - at if at in ends.pdfs else None


def _gzip(b: bytes, at: int) -> int | None:
    unpack = zlib.decompressobj(31)
    rest = memoryview(b)[at:]
    try:
        while not unpack.eof and len(rest):
            unpack.decompress(rest, 1 << 20)
            rest = unpack.unconsumed_tail
    except zlib.error:
        return None
    return len(b) - at - len(unpack.unused_data) if unpack.eof else None


_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def _ogg_crc(data: bytes) -> int:
    """The format's checksum (highest bit first, from 0), which is zlib's with all bits mirrored."""
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _ogg(b: bytes, at: int) -> int | None:
    p = at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b):
        table = b[p + 27 : p + 27 + b[p + 26]]
        end = p + 27 + b[p + 26] + sum(table)
        if end > len(b) or _ogg_crc(b[p : p + 22] + bytes(4) + b[p + 26 : end]) != int.from_bytes(b[p + 22 : p + 26], "little"):
            return None
        last, p = b[p + 5] & 4, end
        if last:
            return p - at
    return None


def _mp4(b: bytes, at: int) -> int | None:
    p, kinds = at, set()
    while p + 8 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if n == 1 and p + 16 <= len(b):
            n = int.from_bytes(b[p + 8 : p + 16], "big")
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"sidx", b"styp", b"meta", b"uuid", b"wide") or n < 8 or p + n > len(b):
            break
        kinds.add(kind)
        p += n
    return p - at if {b"ftyp", b"moov"} <= kinds else None


#: Fixed values of the formats: type, magic bytes, their offset in the object, validator.
FORMATS: list[tuple[str, bytes, int, Callable[..., int | None]]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("audio/wav", b"WAVEfmt ", 8, _riff),
    ("image/webp", b"WEBPVP8", 8, _riff),
    ("video/x-msvideo", b"AVI LIST", 8, _riff),
    ("image/bmp", b"BM", 0, _bmp),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/ogg", b"OggS", 0, _ogg),
    ("video/mp4", b"ftyp", 4, _mp4),
]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (_, magic, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), (k, len(magic)))
    found.make_automaton()
    return found


def sniff(blob: bytes | None, automaton: ahocorasick.Automaton) -> tuple[str, list[tuple[str, int, int]], int]:
    """True type, valid objects as (type, offset, length), and the number of magic hits."""
    if not blob:
        return "application/octet-stream", [], 0
    hits = sorted((end + 1 - n - FORMATS[k][2], k) for end, (k, n) in automaton.iter(blob.decode("latin-1")))
    objects: list[tuple[str, int, int]] = []
    covered, ends = 0, Ends(blob)
    for at, k in hits:
        if at < covered:
            continue
        kind, _, _, validate = FORMATS[k]
        if (length := validate(blob, at, ends) if validate in (_zip, _pdf) else validate(blob, at)) is not None:
            objects.append((kind, at, length))
            covered = at + length
    if objects:
        return objects[0][0], objects, len(hits)
    if b"\0" not in blob:
        try:
            blob.decode("utf-8")
            return "text/plain", [], len(hits)
        except UnicodeDecodeError:
            pass
    return "application/octet-stream", [], len(hits)


_OBJECT = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])
_SNIFFED = pa.schema([("true_type", pa.string()), ("corrected", pa.bool_()), ("n_hits", pa.int32()), ("objects", pa.list_(_OBJECT))])


def sniff_media(df: DataFrame, *, id_col: str, blob_col: str, declared_col: str | None = None, derive: Callable[..., tuple] | None = None, derived: pa.Schema | None = None) -> DataFrame:
    """``id_col``, true_type, corrected (it differs from the declared type), n_hits and the carved objects of each row.

    With ``derive``, the columns ``derived`` that it makes of (true_type, corrected, objects as (type, offset, data)) stand for the
    last four, so carved data stay in the task that carves them.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(blob_col).cast("binary").alias("blob"), (F.col(declared_col) if declared_col else F.lit(None).cast("string")).alias("declared"))
    fields = derived if derive else _SNIFFED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for blob, declared in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    kind, objects, n = sniff(blob, automaton)
                    fixed, carved = declared is not None and declared != kind, [(t, o, blob[o : o + m]) for t, o, m in objects]
                    out.append(derive(kind, fixed, carved) if derive else (kind, fixed, n, [{"type": t, "offset": o, "length": len(data), "data": data} for t, o, data in carved]))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True))], names=["id", *fields.names])

    return rows.mapInArrow(run, StructType([StructField("id", df.schema[id_col].dataType), *from_arrow_schema(fields)])).withColumnRenamed("id", id_col)


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit PCM; the number of samples must be even."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def wav_samples(media: bytes) -> bytes:
    """The samples of a valid WAV object."""
    p = 12
    while p + 8 <= len(media):
        n = int.from_bytes(media[p + 4 : p + 8], "little")
        if media[p : p + 4] == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


#: What stands before and after the media in its carrier: a page of another declared type.
PREFIX, SUFFIX = b"<object type=text/html>\n", b"\n</object>\n"


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as UTF-8, zero-padded to a positive multiple of 64, as 8-bit samples in WAV objects within carriers declared ``text/html``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, blobs = [], []
                for text in part.column(1).cast(pa.large_binary()).to_pylist():
                    raw = text or b""
                    sizes.append(len(raw))
                    blobs.append(PREFIX + wav(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))) + SUFFIX)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary()), pa.array(["text/html"] * part.num_rows)], names=["id", "n_bytes", "carrier", "declared"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_bytes long, carrier binary, declared string").withColumnRenamed("id", id_col)


def sample_features(samples: bytes) -> str:
    """Mean, deviation, zero crossings and silent share of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"n={len(x)};mean={x.mean():.4f};std={x.std():.4f};crossings={crossings};silent={np.count_nonzero(x == -128)}"


_DIGESTS = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digests(true_type: str, corrected: bool, objects: list[tuple[str, int, bytes]]) -> tuple:
    """The fields of ``_DIGESTS`` of the first object's samples."""
    _, offset, media = objects[0]
    payload = wav_samples(media)
    feature = f"{true_type};corrected={int(corrected)};objects={len(objects)};offset={offset};{sample_features(payload)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op6_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = store_texts(docs).withColumn("key", F.struct("doc_id", "n_bytes"))
    return sniff_media(stored, id_col="key", blob_col="carrier", declared_col="declared", derive=_digests, derived=_DIGESTS).select("key.*", *_DIGESTS.names)
