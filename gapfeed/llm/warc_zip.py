"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`,
one gzip member for each record, and `indexes/index.cdxj`, a line for each
record with its offset and length in the archive. The reader parses the end
record, the ZIP64 records if they are there and the central directory, finds
the stored members through their local headers, reads the index and then
ranges of records, several tasks to a large package.

Records with equal payloads of at least `revisit_bytes` bytes: the one of the
smallest id is the response, the others revisit it. Null payloads are empty;
smaller payloads are all responses. Rows without an id are written but never
referred to. Repeated rows (equal id and payload) are all responses if the
id is the smallest. An empty table makes no package, and reading none yields no rows.

Packages are written to a shared folder through Arrow's file systems under
names of their own for each attempt; the manifest, written by Spark, names
those of the attempts that counted. Payloads pass through one task's memory
one record at a time; compression is by record.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfeed.llm._common import materialize, scratch_path, sized_broadcast

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of one package's archive, of one range read, and of the records that one reading task takes on.
PACKAGE_BYTES, RANGE_BYTES, SPLIT_BYTES = 64 << 20, 4 << 20, 32 << 20

_END, _END64, _LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


# writing -----------------------------------------------------------------


def warc_record(kind: str, record_id: str, uri: str, payload: bytes | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record, compressed as a gzip member of its own."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=1, mtime=0)


class PackageWriter:
    """A ZIP of stored members, written front to back. zip64: always write the ZIP64 records."""

    def __init__(self, out, zip64: bool = True):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []
        self._start(ARCHIVE)
        self.index: list[str] = []

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _start(self, name: str) -> None:
        self.member = [name, self.at, 0, 0]
        raw = name.encode()
        # sizes and checksum follow the data (bit 3); 64-bit ones as the extra field says
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 8, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def _data(self, raw: bytes) -> None:
        self.member[2] += len(raw)
        self.member[3] = zlib.crc32(raw, self.member[3])
        self._write(raw)

    def _finish(self) -> None:
        _, _, size, crc = self.member
        self._write(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
        self.members.append(self.member)

    def add(self, key: str, record: bytes) -> None:
        self.index.append(json.dumps({"key": key, "offset": self.member[2], "length": len(record)}))
        self._data(record)

    @property
    def archive_bytes(self) -> int:
        return self.member[2]

    def close(self) -> int:
        """Index, central directory and end records; the number of bytes written."""
        self._finish()
        self._start(INDEX)
        self._data(("\n".join(self.index) + "\n").encode() if self.index else b"")
        self._finish()
        start = self.at
        for name, offset, size, crc in self.members:
            raw = name.encode()
            big = self.zip64
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            small = (0xFFFFFFFF,) * 3 if big else (size, size, offset)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 8, 0, 0, 0x21, crc, small[0], small[1], len(raw), len(extra), 0, 0, 0, 0, small[2]) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64:
            end = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<4sIQI", _LOCATOR64, 0, end, 1))
            self._write(struct.pack("<4sHHHHIIH", _END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            self._write(struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, size, start, 0))
        self.out.close()
        return self.at


def record_plan(pages: DataFrame, revisit_bytes: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is the id of the response that a revisit means."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # only groups of several records matter; they are counted before the shuffle, payloads stay where they are
    groups = rows.where(F.length("payload") >= revisit_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    groups = sized_broadcast(materialize(groups, "equal-payloads"), 500_000)
    return rows.join(groups, "digest", "left").select("id", "url", "payload", "digest", F.when(F.col("first") != F.coalesce("id", F.lit(-1) if dict(pages.dtypes)[id_col] in ("bigint", "int") else F.lit("")), F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, revisit_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the packages and returns their manifest: (path, bytes, records)."""
    plan = record_plan(pages, revisit_bytes, id_col, url_col, payload_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)
        writer, path, made, count = None, None, [], 0
        for batch in batches:
            for key, url, payload, digest, refers in zip(*(batch.column(i) for i in range(5))):
                if writer is None:
                    path, count = f"{base.rstrip('/')}/{uuid.uuid4().hex}.wacz", 0
                    writer = PackageWriter(store.open_output_stream(path))
                payload, refers = payload.as_py(), refers.as_py()
                name = json.dumps(key.as_py())
                uri = (url.as_py() or "urn:unknown").replace("\r", "").replace("\n", "")
                kind = "response" if refers is None else "revisit"
                writer.add(name, warc_record(kind, f"urn:row:{name}", uri, payload if refers is None else None, digest.as_py(), len(payload), None if refers is None else f"urn:row:{json.dumps(refers)}"))
                count += 1
                if writer.archive_bytes >= package_bytes:
                    made.append((path, writer.close(), count))
                    writer = None
        if writer is not None:
            made.append((path, writer.close(), count))
        scheme = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
        yield pa.RecordBatch.from_arrays([pa.array([scheme + p for p, _, _ in made], pa.string()), pa.array([b for _, b, _ in made], pa.int64()), pa.array([n for *_, n in made], pa.int64())], names=["path", "bytes", "records"])

    return materialize(plan.mapInArrow(run, "path string, bytes long, records long"), "manifest")


# reading -----------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    size: int
    method: int


def read_at(f, offset: int, length: int) -> bytes:
    f.seek(offset)
    return f.read(length)


def directory(f, size: int) -> list[Member]:
    """The members that a ZIP's central directory lists; ZIP64 records are followed where they are."""
    tail_at = max(0, size - 65_557)
    tail = read_at(f, tail_at, size - tail_at)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no end record: not a ZIP file")
    _, _, _, _, count, length, start, _ = struct.unpack("<4sHHHHIIH", tail[at : at + 22])
    if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR64:
        (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        raw = read_at(f, end64, 56)
        if raw[:4] != _END64:
            raise ValueError("the ZIP64 locator doesn't point at an end record")
        count, length, start = struct.unpack("<QQQ", raw[32:56])
    elif 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        raise ValueError("a ZIP64 end record is missing")
    raw, out, p = read_at(f, start, length), [], 0
    for _ in range(count):
        sig, _, _, _, method, _, _, _, packed, plain, names, extras, notes, _, _, _, offset = struct.unpack("<4sHHHHHHIIIHHHHHII", raw[p : p + 46])
        if sig != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        name = raw[p + 46 : p + 46 + names].decode()
        extra = raw[p + 46 + names : p + 46 + names + extras]
        q = 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:
                wide, w = extra[q + 4 : q + 4 + n], 0
                if plain == 0xFFFFFFFF:
                    (plain,), w = struct.unpack("<Q", wide[w : w + 8]), w + 8
                if packed == 0xFFFFFFFF:
                    (packed,), w = struct.unpack("<Q", wide[w : w + 8]), w + 8
                if offset == 0xFFFFFFFF:
                    (offset,), w = struct.unpack("<Q", wide[w : w + 8]), w + 8
            q += 4 + n
        out.append(Member(name, offset, packed, method))
        p += 46 + names + extras + notes
    return out


def data_start(f, m: Member) -> int:
    """Where a stored member's bytes begin: behind its local header."""
    if m.method:
        raise ValueError(f"{m.name} is compressed; only stored members can be read by ranges")
    raw = read_at(f, m.offset, 30)
    if raw[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {m.name}")
    names, extras = struct.unpack("<HH", raw[26:30])
    return m.offset + 30 + names + extras


def split_index(index: bytes, split_bytes: int) -> list[list[tuple[int, int]]]:
    """Record ranges of an index, in runs of about split_bytes."""
    runs, size = [[]], 0
    for line in index.splitlines():
        entry = json.loads(line)
        if size >= split_bytes:
            runs.append([])
            size = 0
        runs[-1].append((entry["offset"], entry["length"]))
        size += entry["length"]
    return [r for r in runs if r]


def splits(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, offsets, lengths): what each reading task takes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                store, name = open_fs(path)
                with store.open_input_file(name) as f:
                    members = {m.name: m for m in directory(f, f.size())}
                    start, index = data_start(f, members[ARCHIVE]), members[INDEX]
                    for run_ in split_index(read_at(f, data_start(f, index), index.size), split_bytes):
                        rows.append((path, start, [o for o, _ in run_], [n for _, n in run_]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["path", "start", "offsets", "lengths"])

    return manifest.select("path").mapInArrow(run, "path string, start long, offsets array<long>, lengths array<long>")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and HTTP payload of a decompressed record."""
    end = raw.index(b"\r\n\r\n")
    head = {}
    for line in raw[:end].decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        head[name.strip().lower()] = value.strip()
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    http = block.find(b"\r\n\r\n")
    return head, block[http + 4 :]


def read_packages(manifest: DataFrame, id_type: str = "long", with_payload: bool = False, range_bytes: int = RANGE_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of all packages: (id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]).
    The digest of a response is taken from its payload and must be the one that its header states."""
    tasks = materialize(splits(manifest, split_bytes), "splits")
    n = max(1, min(tasks.count(), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, offsets, lengths in zip(*(batch.column(i).to_pylist() for i in range(4))):
                store, name = open_fs(path)
                rows, held = [], 0
                with store.open_input_file(name) as f:
                    i = 0
                    while i < len(offsets):
                        j = i + 1
                        while j < len(offsets) and offsets[j] == offsets[j - 1] + lengths[j - 1] and offsets[j] + lengths[j] - offsets[i] <= range_bytes:
                            j += 1
                        chunk = memoryview(read_at(f, start + offsets[i], offsets[j - 1] + lengths[j - 1] - offsets[i]))
                        for k in range(i, j):
                            head, payload = parse_record(gzip.decompress(chunk[offsets[k] - offsets[i] :][: lengths[k]]))
                            digest = head["warc-payload-digest"].removeprefix("sha256:")
                            kind = head["warc-type"]
                            size = len(payload) if kind == "response" else int(head["x-payload-length"])
                            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: a payload isn't what its digest says")
                            key = json.loads(head["warc-record-id"].removeprefix("<urn:row:").removesuffix(">"))
                            refers = head.get("warc-refers-to")
                            rows.append((key, head["warc-target-uri"], size, digest, kind, None if refers is None else json.loads(refers.removeprefix("<urn:row:").removesuffix(">")), payload if with_payload else None))
                            held += len(payload)
                        i = j
                        if with_payload and held > 16 << 20:
                            yield _rows(rows, id_type, with_payload)
                            rows, held = [], 0
                yield _rows(rows, id_type, with_payload)

    schema = f"id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}" + ", payload binary" * with_payload
    return tasks.repartition(n).mapInArrow(run, schema)


def _rows(rows: list[tuple], id_type: str, with_payload: bool) -> pa.RecordBatch:
    key = pa.int64() if id_type in ("long", "bigint") else pa.int32() if id_type == "int" else pa.string()
    types = [key, pa.string(), pa.int64(), pa.string(), pa.string(), key] + [pa.binary()] * with_payload
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def round_trip(spark: SparkSession, pages: DataFrame, revisit_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each page to the shared scratch folder and reads the packages back."""
    manifest = write_packages(pages, scratch_path(spark, "warc"), revisit_bytes, id_col, url_col, payload_col)
    return read_packages(manifest, pages.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
