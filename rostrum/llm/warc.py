"""WARC archives as a Python data source, and page archives with revisit records.

Reading plans groups of files as partitions. Of a record the headers are parsed first;
predicates on them are pushed down, and the payload of a record that fails them - or of
any record, with option `payload=false` - is skipped, not decoded: members written here
carry their compressed length, so the reader seeks to the next one.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
    IsNotNull, StringStartsWith, WriterCommitMessage,
)

from rostrum.session import durable, landing, until_exit

FORMAT = "rostrum_warc"
SCHEMA = ("record_type string, record_id string, target_uri string, date string, refers_to string, "
          "payload_digest string, payload_bytes bigint, payload binary")
WRITTEN = "record_type string, record_id string, target_uri string, refers_to string, payload binary"
HEADERS = {  # column to header
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
FILE_BYTES = 256 << 20
PARTITION_BYTES = 128 << 20
READ_AHEAD = 1 << 13
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1 << 12

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """Blanks and control characters percent-encoded: they would break the header."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes,
           date: str) -> bytes:
    """One record. A revisit keeps the HTTP headers, with the full length, and no payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_safe(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_safe(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{_safe(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member of its own, with the `sl` field: compressed and plain length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 24 + len(body) + 8
    if size >= 1 << 32 or len(raw) >= 1 << 32:  # the field holds 32 bits
        head = struct.pack("<4BIBB", 0x1F, 0x8B, 8, 0, 0, 0, 255)
    else:
        head = struct.pack("<4BIBBH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(raw))
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class _Source:
    """Reads a record's bytes from the front of a member or of a plain file, on demand."""

    def __init__(self, file, at: int, packed: bool):
        self.file, self.at, self.packed = file, at, packed
        self.plain = b""
        if packed:
            self.inflate = zlib.decompressobj(31)
        file.seek(at)
        self.taken = 0  # compressed or plain bytes read from the file

    def more(self) -> bool:
        if self.packed and self.inflate.eof:
            return False
        raw = self.file.read(READ_AHEAD if len(self.plain) < READ_AHEAD else 1 << 18)
        if not raw:
            return False
        self.taken += len(raw)
        self.plain += self.inflate.decompress(raw) if self.packed else raw
        return True

    def upto(self, mark: bytes, start: int) -> int:
        while (end := self.plain.find(mark, start)) < 0:
            if not self.more():
                raise ValueError(f"truncated record at byte {self.at}")
        return end + len(mark)

    def need(self, n: int) -> None:
        parts, have = [self.plain], len(self.plain)
        self.plain = b""
        while have < n:
            if not self.more():
                raise ValueError(f"truncated record at byte {self.at}")
            parts.append(self.plain)
            have += len(self.plain)
            self.plain = b""
        self.plain = b"".join(parts)

    def end(self, length: int) -> int:
        """Where the next record begins; `length`: plain bytes of this one."""
        if not self.packed:
            return self.at + length
        self.file.seek(self.at)
        head = self.file.read(24)
        if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            return self.at + struct.unpack("<I", head[16:20])[0]
        self.file.seek(self.at + self.taken)
        while not self.inflate.eof:
            raw = self.file.read(1 << 18)
            if not raw:
                raise ValueError(f"truncated record at byte {self.at}")
            self.taken += len(raw)
            self.inflate.decompress(raw)
        return self.at + self.taken - len(self.inflate.unused_data)


def _fields(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def records(file, size: int, packed: bool, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA of a file's records whose header columns pass `wanted`."""
    at = 0
    while at < size:
        source = _Source(file, at, packed)
        start = source.upto(b"\r\n\r\n", 0)
        head = _fields(source.plain[:start])
        length = int(head["content-length"])
        row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if wanted(row):
            first, told = start, None
            if length and "application/http" in head.get("content-type", ""):
                first = source.upto(b"\r\n\r\n", start)
                told = _fields(source.plain[start:first]).get("content-length")
            n = length - (first - start)
            body = None
            if payload and row["record_type"] != "revisit":
                source.need(start + length)
                body = source.plain[first:start + length]
            if row["record_type"] == "revisit":
                n = int(told) if told is not None else None
            yield (*(row[c] for c in HEADERS), n, body)
        at = source.end(start + length + 4)


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcSource(DataSource):
    """`spark.read.format("rostrum_warc").load(folder)` and its `write`.

    Options: `payload` (true), `partition_bytes`, `file_bytes`, `date`. Paths are what
    pyarrow's file systems open (local, HDFS, S3, GCS).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "there", ()))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for column, how, values in self.tests:
            v = row[column]
            if v is None or how == "in" and v not in values or how == "starts" and not v.startswith(values):
                return False
        return True

    def partitions(self) -> list[Files]:
        where, root = fs.FileSystem.from_uri(self.path)
        listed = {i.base_name: i for i in where.get_file_info(fs.FileSelector(root, recursive=False))}
        if MANIFEST in listed:  # only files of tasks that committed
            with where.open_input_stream(listed[MANIFEST].path) as f:
                files = [(f"{root}/{n}", size) for n, size in json.loads(f.read())]
        else:
            files = [(i.path, i.size) for i in where.get_file_info(fs.FileSelector(root, recursive=True))
                     if re.search(r"\.warc(\.gz)?$", i.path)]
        groups, room = [], 0
        for path, size in sorted(files, key=lambda x: (-x[1], x[0])):
            if not groups or room < size:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append((path, size))
            room -= size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for path, size in partition.paths:
            with where.open_input_file(path) as file:
                for row in records(file, size, path.endswith(".gz"), self.wanted, self.payload):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]
    cells = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(cells, kinds)], [*HEADERS, "payload_bytes", "payload"]
    )


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own; the commit names those of the tasks that count,
    so a task that ran twice leaves no second copy of its records."""

    def __init__(self, options, schema):
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.names = [f.name for f in schema.fields]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(self.names.index(c)).to_pylist() for c in
                       ("record_type", "record_id", "target_uri", "refers_to", "payload")]
            for kind, record_id, uri, refers_to, payload in zip(*columns):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = where.open_output_stream(f"{root}/{name}", compression=None), 0
                raw = member(record(kind, record_id, uri, refers_to, bytes(payload or b""), self.date))
                out.write(raw)
                size += len(raw)
                if size >= self.file_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        with where.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            where.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                 least: int = 0) -> DataFrame:
    """The WRITTEN columns of a record per page. Of pages with equal payloads of at least
    `least` bytes the smallest id is the response and the others revisit it; with a
    smaller payload every page is a response. Null html is empty; rows without an id
    count as the largest. Payloads are compared by SHA-1, and only digests are shuffled
    to find the equal ones; digests seen once need no join.
    """
    rows = pages.select(
        F.col(f"`{page_id}`").cast("bigint").alias("page"), F.col(f"`{url}`").alias("target_uri"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    firsts = durable(
        rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(
            F.min("page").alias("first"), F.count("*").alias("n")
        ).where("n > 1 and first is not null").select("digest", "first"), "payloads",
    )
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page"))
    return rows.join(firsts, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        _record_id("page").alias("record_id"), "target_uri",
        F.when(again, _record_id("first")).alias("refers_to"), "payload",
    )


def _record_id(page: str):
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), "digest")


def page_of(record_id):
    """The page id in a record id; null if the page had none."""
    part = F.split_part(record_id, F.lit(":"), F.lit(3))
    return F.when(part != "", part).cast("bigint")


def archive(pages: DataFrame, folder: str | None = None, **options) -> str:
    """Write `pages` as archives and name their folder: by default a new one, which goes when the
    program ends."""
    spark = pages.sparkSession
    register(spark)
    own = folder is None
    folder = folder or landing(spark, "warc")
    page_records(pages).write.format(FORMAT).mode("append").options(**options).save(folder)
    if own:
        until_exit(spark, folder)
    return folder


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(folder)
