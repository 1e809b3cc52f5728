"""WARC archives as a PySpark Python data source, and page tables stored in them.

``spark.read.format("warc")`` plans partitions over files, takes predicates on the record type
and other header fields, parses the headers of a record first, and seeks past the
payload of a record that they reject or whose payload no wanted column needs: give a
``schema`` without ``payload`` and ``payload_sha1`` and no payload is read. In compressed archives that
this writer made, each record is a gzip member that tells its length, and is inflated as far as
it is read; others are inflated whole.
``df.write.format("warc")`` rolls files at ``target_bytes``, so that a file is a fair partition;
a manifest written at commit names the files of finished tasks, so retried tasks leave nothing.

Defined cases: a null payload is empty; null header fields are left out and read back as null; line
breaks in header values become spaces; a truncated or malformed record raises ValueError
with its file and offset; an empty table writes an empty manifest and reads back as no rows; other
columns are ignored by the writer, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .shared import cut, new_path

#: Column, header of the WARC format.
HEADER_OF = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "profile": "warc-profile",
    "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADER_OF) + ", content_length long, http_status int, http_content_length long, payload_bytes long, payload_sha1 string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_files.json"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


@dataclass
class Files(InputPartition):
    """Some archives, read one after another."""

    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _fields(block: bytes) -> dict[str, str]:
    """Header lines to a dict with lower-case names; of repeated names the first counts."""
    found: dict[str, str] = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return found


def _holds(predicate, value: str | None) -> bool:
    match predicate:
        case IsNull():
            return value is None
        case IsNotNull():
            return value is not None
        case EqualNullSafe(value=v):
            return value == v
        case EqualTo(value=v):
            return value is not None and value == v
        case In(value=v):
            return value is not None and value in v
        case StringStartsWith(value=v):
            return value is not None and value.startswith(v)
        case StringEndsWith(value=v):
            return value is not None and value.endswith(v)
        case StringContains(value=v):
            return value is not None and v in value
    raise TypeError(predicate)


TESTED = (IsNull, IsNotNull, EqualNullSafe, EqualTo, In, StringStartsWith, StringEndsWith, StringContains)


def deflated(data: bytes) -> bytes:
    """A gzip member whose header tells its length (field ``sl`` of the WARC format), so readers can seek past it."""
    pack = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x04\xff" + struct.pack("<H2sHII", 12, b"sl", 8, len(body) + 32, len(data) % 2**32) + body + struct.pack("<II", zlib.crc32(data), len(data) % 2**32)


def _skip_length(head: bytes) -> int | None:
    if head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"sl\x08\x00":
        return None
    return struct.unpack_from("<I", head, 16)[0]


class Inflated(io.RawIOBase):
    """A gzip member that is inflated no further than it is read."""

    def __init__(self, raw, length: int):
        self.raw, self.left, self.unpack = raw, length, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.unpack.eof:
            packed = self.unpack.unconsumed_tail
            if not packed:
                packed = self.raw.read(min(self.left, 1 << 13))
                self.left -= len(packed)
                if not packed:
                    return 0
            if data := self.unpack.decompress(packed, len(buffer)):
                buffer[: len(data)] = data
                return len(data)
        return 0


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema, split_bytes: int):
        self.path, self.names, self.split_bytes = path, schema.fieldNames(), split_bytes
        self.predicates: list = []
        self.wants_payload = bool({"payload", "payload_sha1"} & set(self.names))
        self.wants_http = bool({"http_status", "http_content_length", "payload_bytes"} & set(self.names))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, TESTED) and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                self.predicates.append(f)
            else:
                yield f

    def partitions(self):
        """Files in groups of up to ``split_bytes``; a larger file is a partition by itself."""
        system, root = _open(self.path)
        infos = system.get_file_info(root)
        if infos.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if infos.type == pafs.FileType.File:
            found = [infos]
        else:
            manifest = system.get_file_info(posixpath.join(root, MANIFEST))
            if manifest.type == pafs.FileType.File:
                with system.open_input_file(manifest.path) as f:
                    listed = json.loads(f.read())
                found = system.get_file_info([posixpath.join(root, x) for x in listed]) if listed else []
            else:
                found = [x for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
        groups: list[list[str]] = []
        room = 0
        for x in sorted(found, key=lambda x: x.path):
            if not groups or x.size > room:
                groups.append([])
                room = self.split_bytes
            groups[-1].append(x.path)
            room -= x.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        rows: list[dict] = []
        held = 0
        for name in partition.names:
            for row in self._records(system, name):
                rows.append(row)
                held += 200 + len(row.get("payload") or b"")
                if held > 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "http_status": pa.int32()} | dict.fromkeys(("content_length", "http_content_length", "payload_bytes"), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in self.names], names=self.names)

    def _records(self, system: pafs.FileSystem, name: str) -> Iterator[dict]:
        with system.open_input_file(name) as raw:
            if not name.endswith(".gz"):
                source = io.BufferedReader(raw, 1 << 16)
            elif _skip_length(raw.read(64)) is None:
                raw.seek(0)
                source = gzip.GzipFile(fileobj=raw)
            else:  # members tell their lengths: inflate what is wanted and seek past the rest
                at, size = 0, raw.size()
                while at < size:
                    raw.seek(at)
                    if (length := _skip_length(raw.read(64))) is None:
                        raise ValueError(f"{name}: no member length at byte {at}")
                    raw.seek(at)
                    row, _ = self._one(io.BufferedReader(Inflated(raw, length), 1 << 12), name, at)
                    if row is not None:
                        yield row
                    at += length
                return
            while True:
                at = source.tell()
                row, end = self._one(source, name, at)
                if end is None:
                    return
                if row is not None:
                    yield row
                source.seek(end)

    def _one(self, source, name: str, at: int) -> tuple[dict | None, int | None]:
        """The row of the next record, or None if a predicate rejects its headers, and where the record ends (None: no more)."""
        first = source.readline()
        while first in (b"\r\n", b"\n"):
            first = source.readline()
        if not first:
            return None, None
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        head = self._head(source, name, at)
        length = int(head.get("content-length", "-1"))
        if length < 0:
            raise ValueError(f"{name}: record at byte {at} has no length")
        end = source.tell() + length if source.seekable() else -1
        row = {c: head.get(h) for c, h in HEADER_OF.items()} | {"content_length": length}
        if not all(_holds(p, row[p.attribute[0]]) for p in self.predicates):
            return None, end
        size = length
        if (self.wants_payload or self.wants_http) and "msgtype=response" in head.get("content-type", "").replace(" ", ""):
            line = source.readline()
            status = line.split(None, 2)
            used: list[int] = [len(line)]
            http = self._head(source, name, at, used)
            size = length - sum(used)
            row["http_status"] = int(status[1]) if len(status) > 1 and status[1].isdigit() else None
            row["http_content_length"] = int(n) if (n := http.get("content-length", "")).isdigit() else None
        row["payload_bytes"] = size
        if self.wants_payload:
            data = source.read(size)
            if len(data) != size:
                raise ValueError(f"{name}: record at byte {at} is cut off")
            if "payload_sha1" in self.names:
                row["payload_sha1"] = base32_sha1(data)
            row["payload"] = data
        return row, end

    @staticmethod
    def _head(source, name: str, at: int, used: list[int] | None = None) -> dict[str, str]:
        lines = []
        while True:
            line = source.readline()
            if used is not None:
                used.append(len(line))
            if line in (b"\r\n", b"\n"):
                return _fields(b"\r\n".join(lines))
            if not line:
                raise ValueError(f"{name}: headers of the record at byte {at} are cut off")
            lines.append(line.rstrip(b"\r\n"))


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, target_bytes: int, compress: bool):
        self.path, self.target_bytes, self.compress = path, target_bytes, compress

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out = None
        for batch in iterator:
            have = [c for c in (*HEADER_OF, "payload", "full_payload_bytes") if c in batch.schema.names]
            for values in zip(*(batch.column(c) for c in have), strict=True):
                row = {c: v.as_py() for c, v in zip(have, values, strict=True)}
                if out is None or out.tell() >= self.target_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress)
                    out = system.open_output_stream(posixpath.join(root, names[-1]), compression=None)
                data = record(row)
                out.write(deflated(data) if self.compress else data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        manifest = posixpath.join(root, MANIFEST)
        names: list[str] = []
        if system.get_file_info(manifest).type == pafs.FileType.File:
            with system.open_input_file(manifest) as f:
                names = json.loads(f.read())
        with system.open_output_stream(manifest) as f:
            f.write(json.dumps(sorted({*names, *(n for m in messages if m is not None for n in m.names)})).encode())

    def abort(self, messages) -> None:
        system, root = _open(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                system.delete_file(posixpath.join(root, n))


def record(row: dict) -> bytes:
    """One record. Responses and revisits carry HTTP headers with the length of the full payload; a revisit carries no payload."""
    payload = row.get("payload") or b""
    full = row["full_payload_bytes"] if row.get("full_payload_bytes") is not None else len(payload)
    block = payload
    if row.get("record_type") in ("response", "revisit"):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1"]
    for column, header in HEADER_OF.items():
        if (value := row.get(column)) is not None:
            lines.append(f"{'-'.join(x.upper() if x in ('warc', 'id', 'uri') else x.capitalize() for x in header.split('-'))}: {' '.join(str(value).split())}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcDataSource(DataSource):
    """Options: path; split_bytes (read); target_bytes, compress (write)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("split_bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("target_bytes", 64 << 20)), self.options.get("compress", "true") == "true")


def register(spark: SparkSession) -> None:
    """Make the format known to the session and turn on filter pushdown to Python sources, which is a setting of the caller's session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records to write: of pages with equal payloads of ``least_bytes`` or more, the one with the largest id is the response.

    Without ids to tell them apart, all with the largest id are responses; a page without
    an id revisits one that has one. The ids of responses are found from digests alone and written before they meet the
    payloads, so Spark may broadcast them by their size, or split a hot digest (an error page of a third of all pages).
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html")))
    again = cut(rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    rows = rows.join(again, "digest", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False)))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return rows.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(F.col("revisit"), urn(F.col("first_id"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest"))).alias("payload_digest"),
        F.when(F.col("revisit"), PROFILE).alias("profile"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.octet_length("html").cast("long").alias("full_payload_bytes"),
        F.when(~F.col("revisit"), F.encode("html", "UTF-8")).alias("payload"),
    )


def base32_of_hex(column):
    """Base32 of 20 bytes in hex: four groups of 40 bits, each eight letters of five bits."""
    groups = [F.conv(F.substring(column, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(letters, (F.shiftright(g, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), 1) for g in groups for k in range(8)])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = new_path(spark, "warc")
    with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").option("path", path).save()
    wanted = "record_type string, record_id string, refers_to string, payload_digest string, http_content_length long, payload_bytes long, payload_sha1 string"
    back = spark.read.format("warc").schema(wanted).option("path", path).load().where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    response = F.col("record_type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("http_content_length")).alias("payload_bytes"),
        F.when(response, F.col("payload_sha1")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
