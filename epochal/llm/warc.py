"""WARC records in ZIP archives, written from pages and read back by range.

Writing: every task packs its pages into ZIP archives of some ``archive_bytes``.
An archive holds WARC files under archive/, stored and not compressed by ZIP
(each record is a gzip member of its own), and a line for each record under
indexes/: file, offset, length. Of pages with equal payloads of at least
``least_bytes``, the one with the largest page_id is a response and the others
are revisit records, which name it and carry headers only.

Reading: the end record, the ZIP64 end record if there is one, and the central
directory give the stored members; the index gives the records; each record is
read by its byte range, and nothing is extracted. A record whose payload does not
have the digest in its header is an error.

Files go to the shared folder through Arrow's file systems, so any task on any
machine can read them. A task that runs twice writes files of other names, and
only the files in the written manifest count, so lost executors do no harm.

Defined results: a null html is an empty payload; payloads are equal when their
SHA-256 is. A null page_id is less than any other; a group in which all are null
has no revisits. Rows alike in page_id and payload that hold the largest page_id
are all responses. Control characters in URLs are percent-encoded, a null URL
leaves its header out. An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BROADCAST_ROWS, looked_up, mapped, pick, shared_dir, written

LEAST_BYTES = 1000
MEMBER_BYTES, ARCHIVE_BYTES = 16 << 20, 64 << 20
DATE = "2000-01-01T00:00:00Z"  # pages carry no time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    kind: str
    payload_bytes: int
    digest: str
    refers_to: int | None
    payload: bytes | None


def record_bytes(r: Record) -> bytes:
    """One record as a gzip member."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r.url) if r.url is not None else None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode() + (r.payload or b"")
    head = {"WARC-Type": r.kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r.page_id} {r.digest} {url}')}>", "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{r.digest}", "X-Page-ID": None if r.page_id is None else json.dumps(r.page_id)}
    if r.kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": json.dumps(r.refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 4, mtime=0)


def parsed(member: bytes) -> Record:
    """The record in a gzip member; its payload must have the digest of its header."""
    raw = gzip.decompress(member)
    head, block = raw.split(b"\r\n\r\n", 1)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    field = dict(x.split(": ", 1) for x in lines)
    block = block[: int(field["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page_id, refers_to = (json.loads(field[k]) if k in field else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    if field["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of page {page_id} has another digest than its header")
    return Record(page_id, field.get("WARC-Target-URI"), field["WARC-Type"], size, digest, refers_to, payload if field["WARC-Type"] == "response" else None)


class ArchiveWriter:
    """One ZIP archive; only the WARC file that is open is held in memory."""

    def __init__(self, out: BinaryIO, zip64: bool = False, member_bytes: int = MEMBER_BYTES):
        self.zip, self.zip64, self.member_bytes = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True), zip64, member_bytes
        self.open, self.files, self.lines, self.size, self.records = io.BytesIO(), 0, [], 0, 0

    def add(self, record: Record) -> None:
        data = record_bytes(record)
        self.lines.append(json.dumps({"page": record.page_id, "type": record.kind, "filename": f"data-{self.files:05d}.warc.gz", "offset": self.open.tell(), "length": len(data)}))
        self.open.write(data)
        self.size += len(data)
        self.records += 1
        if self.open.tell() >= self.member_bytes:
            self._flush()

    def _put(self, name: str, data: bytes) -> None:
        with self.zip.open(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), "w", force_zip64=self.zip64) as member:
            member.write(data)

    def _flush(self) -> None:
        if self.open.tell():
            self._put(f"archive/data-{self.files:05d}.warc.gz", self.open.getvalue())
            self.open, self.files = io.BytesIO(), self.files + 1

    def close(self) -> None:
        self._flush()
        self._put("indexes/index.jsonl", "\n".join(self.lines).encode())
        self._put("datapackage.json", json.dumps({"profile": "data-package", "records": self.records}).encode())
        self.zip.close()


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


class ArchiveReader:
    """Reads a ZIP archive by byte ranges; ``source`` has size() and read_at(n, place)."""

    def __init__(self, source):
        self.source = source
        self.members = {m.name: m for m in self._directory()}
        self._data: dict[str, int] = {}

    def _end(self) -> tuple[int, int, int]:
        """Entries, size and place of the central directory."""
        size = self.source.size()
        tail_at = max(0, size - 65557)
        tail = self.source.read_at(size - tail_at, tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # those bytes may stand in the comment
        if at < 0:
            raise ValueError("not a ZIP archive: no end record")
        entries, length, place = struct.unpack("<10xHII", tail[at : at + 20])
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
            (end64,) = struct.unpack("<8xQ4x", tail[at - 20 : at])
            record = self.source.read_at(56, end64)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 end record is not where its locator says")
            entries, length, place = struct.unpack("<32xQQQ", record)
        elif entries == 0xFFFF or length == 0xFFFFFFFF or place == 0xFFFFFFFF:
            raise ValueError("the archive needs a ZIP64 end record and has none")
        return entries, length, place

    def _directory(self) -> Iterator[Member]:
        entries, length, place = self._end()
        raw, at = self.source.read_at(length, place), 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is broken")
            method, packed, full, n, extra, comment, header = struct.unpack("<10xH8xIIHHH8xI", raw[at : at + 46])
            name = raw[at + 46 : at + 46 + n].decode()
            more = raw[at + 46 + n : at + 46 + n + extra]
            k = 0
            while k + 4 <= len(more):
                kind, size = struct.unpack("<HH", more[k : k + 4])
                if kind == 1:  # the 64-bit values of the fields that are full, in this order
                    wide = iter(struct.unpack(f"<{size // 8}Q", more[k + 4 : k + 4 + size // 8 * 8]))
                    full, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (full, packed, header))
                k += 4 + size
            yield Member(name, method, packed, header)
            at += 46 + n + extra + comment

    def read(self, name: str, place: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed, and only stored members can be read by range")
        if name not in self._data:
            n, extra = struct.unpack("<26xHH", self.source.read_at(30, member.header))
            self._data[name] = member.header + 30 + n + extra
        length = member.size - place if length is None else length
        if place < 0 or length < 0 or place + length > member.size:
            raise ValueError(f"{name} has no bytes {place} to {place + length}")
        return self.source.read_at(length, self._data[name] + place)

    def records(self) -> Iterator[Record]:
        for index in sorted(m for m in self.members if m.startswith("indexes/")):
            for line in self.read(index).splitlines():
                entry = json.loads(line)
                yield parsed(self.read(f"archive/{entry['filename']}", entry["offset"], entry["length"]))


#: Schemes of Hadoop's connectors and the ones under which Arrow knows the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfss": "abfss", "abfs": "abfs", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file", "s3": "s3"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a Hadoop URI, and the path in it.

    Object stores take their credentials from the environment of the executors; hdfs and viewfs need libhdfs there.
    """
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return fs.FileSystem.from_uri(uri)
    if scheme not in SCHEMES:
        raise ValueError(f"archives can't be kept at {scheme}: {sorted(SCHEMES)} are known")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


class Bytes:
    """A byte string as a source."""

    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, place: int) -> bytes:
        return self.data[place : place + n]


def marked(pages: DataFrame, least_bytes: int = LEAST_BYTES, bound: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, digest, record_type and refers_to of every page."""
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    index = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = rows.withColumn("digest", F.sha1("html"))
    rows = looked_up(rows, written(index), "key", "copies", bound)
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Write the archives below ``folder``; the written manifest has path and records of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        out = None
        for batch in batches:
            for i in range(len(batch)):
                page_id, url, text, size, digest, kind, refers_to = (batch.column(k)[i].as_py() for k in range(7))
                if out is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    sink = store.open_output_stream(f"{base}/{name}")
                    out = ArchiveWriter(sink, zip64)
                out.add(Record(page_id, url, kind, size, digest, refers_to, text.encode("utf-8", "surrogatepass") if text is not None else None))
                if out.size >= archive_bytes:
                    yield closed(out, sink, name)
                    out = None
        if out is not None:
            yield closed(out, sink, name)

    def closed(out: ArchiveWriter, sink, name: str) -> pa.RecordBatch:
        out.close()
        sink.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([out.records], pa.int64())], names=["path", "records"])

    return written(mapped(pages, run, "path string, records long"))


def read_archives(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Every record of the archives in ``manifest`` (column path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Page ids are whole numbers or, with id_type string, strings.
    """
    if id_type not in ("long", "string"):
        raise ValueError("page ids are long or string")
    own = pa.int64() if id_type == "long" else pa.string()
    schema = f"page_id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, payload binary"
    kinds = [own, pa.string(), pa.int64(), pa.string(), pa.string(), own, pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def table(some: list[Record]) -> pa.RecordBatch:
        columns = zip(*[(r.page_id, r.url, r.payload_bytes, r.digest, r.kind, r.refers_to, r.payload) for r in some])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = opened(path)
                with store.open_input_file(at) as file:
                    some, size = [], 0
                    for record in ArchiveReader(file).records():
                        some.append(record)
                        size += len(record.payload or b"")
                        if size > 1 << 23 or len(some) >= 2000:
                            yield table(some)
                            some, size = [], 0
                    if some:
                        yield table(some)

    archives = manifest.count()
    return mapped(manifest.select("path").repartition(max(1, archives)), run, schema)


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Write every page to archives in the shared folder and read the records back."""
    folder = shared_dir(pages.sparkSession)
    pages = pick(pages, "page_id", "url", "html")
    id_type = "string" if isinstance(pages.schema["page_id"].dataType, T.StringType) else "long"
    pages = pages.withColumn("page_id", F.col("page_id").cast(id_type))
    return read_archives(write_archives(marked(pages, least_bytes, bound), folder, archive_bytes, zip64), id_type)
