"""WARC archives as a PySpark data source, and a round trip that stores equal payloads once.

Writing: each task writes files of its own (a gzip member a record, with the skip-lengths
extra field, so that a reader can pass over a record without decoding it); the names of a
committed job's files go into a manifest, so what a lost or repeated task left is never read.

Reading: one partition a file. Equality and IN predicates on record_type, record_id, refers_to,
target_uri, payload_digest and payload_bytes are pushed down: a member's first block is decoded for its headers, and the
payload of a record that fails a predicate is skipped, not decoded. Option ``payload=false`` leaves payloads out,
``verify=true`` checks their digests.

Defined results of the round trip: null html is an empty payload; a null page_id is a response
and nothing refers to it; repeated rows (same id and payload) are alike. An empty table gives an
empty result; payloads of any length are stored whole; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import scratch

MANIFEST = "_committed"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = 4096
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
PUSHED = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_bytes": "http-content-length"}


def filesystem(path: str):
    """The file system of a URI or path, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    path = path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)  # names of Hadoop's connectors
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, sha1: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the response's HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    uri = "".join(c if c >= " " else f"%{ord(c):02X}" for c in uri)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own length and that of its content."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    total = 24 + len(body) + 8
    return struct.pack("<4BIBBHccHII", 31, 139, 8, 4, 0, 0, 255, 12, b"s", b"l", 8, total, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _headers(raw: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name (and the HTTP content length), and the block's start."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")[1:]
    found = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    stop = raw.find(b"\r\n\r\n", end + 4)
    for line in raw[end + 4 : stop].split(b"\r\n") if stop > 0 else ():
        k, _, v = line.partition(b":")
        if k.strip().lower() == b"content-length":
            found["http-content-length"] = v.strip().decode("ascii", "replace")
    return found, end + 4


def value(column: str, fields: dict[str, str]):
    v = fields.get(PUSHED[column])
    if v is None:
        return None
    if column in ("record_id", "refers_to"):
        return v.strip("<>")
    if column == "payload_digest":
        return v.removeprefix("sha1:")
    return int(v) if column == "payload_bytes" else v


@dataclass
class FilePartition(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in PUSHED:
                self.wanted.append((column, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, root = filesystem(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [FilePartition(self.path)]
        names = []
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.startswith(MANIFEST):
                with fs.open_input_stream(info.path) as f:
                    names += json.loads(f.read())
        if not names:
            names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.endswith((".warc", ".warc.gz"))]
        return [FilePartition(f"{self.path.rstrip('/')}/{n}") for n in sorted(names)]

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
        rows, held = [], 0
        for row in self.rows(partition.path) if partition is not None else ():  # no files: no partition is planned
            rows.append(row)
            held += len(row[-1] or b"") + 300
            if held > 8 << 20:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, held = [], 0
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    def rows(self, path: str) -> Iterator[tuple]:
        fs, name = filesystem(path)
        with fs.open_input_file(name) as f:
            at, size = 0, fs.get_file_info(name).size
            while at < size:
                f.seek(at)
                start = f.read(HEAD)
                at, row = self.zipped(f, at, start) if start[:2] == b"\x1f\x8b" else self.plain(f, at, start)
                if row is not None:
                    yield row

    def row(self, fields: dict[str, str], block) -> tuple | None:
        """The record's row, or None if a pushed predicate fails; ``block()`` decodes the block."""
        if any(value(c, fields) not in v for c, v in self.wanted):
            return None
        payload = None
        if fields.get("warc-type") == "response" and (self.payload or self.verify):
            payload = block().partition(b"\r\n\r\n")[2]
            if self.verify and digest(payload) != value("payload_digest", fields):
                raise ValueError(f"payload digest of {value('record_id', fields)} differs")
        return (*(value(c, fields) for c in list(PUSHED)), payload if self.payload else None)

    def plain(self, f, at: int, start: bytes) -> tuple[int, tuple | None]:
        while b"\r\n\r\n" not in start and len(start) >= HEAD:
            more = f.read(len(start))
            if not more:
                break
            start += more
        fields, head = _headers(start)
        if head < 0:
            raise ValueError("not a WARC record")
        n = int(fields["content-length"])

        def block() -> bytes:
            f.seek(at + head)
            return f.read(n)

        if fields.get("http-content-length") is None and n > len(start) - head:
            fields, _ = _headers(start + f.read(HEAD))
        return at + head + n + 4, self.row(fields, block)

    def zipped(self, f, at: int, start: bytes) -> tuple[int, tuple | None]:
        total = struct.unpack("<I", start[16:20])[0] if start[3] & 4 and start[12:14] == b"sl" else None
        z = zlib.decompressobj(31)
        raw = z.decompress(start, HEAD)
        fields, head = _headers(raw)
        while (head < 0 or raw.find(b"\r\n\r\n", head) < 0) and not z.eof:  # headers longer than a block
            more = z.unconsumed_tail or f.read(HEAD)
            raw += z.decompress(more, HEAD)
            fields, head = _headers(raw)
        if head < 0:
            raise ValueError("not a WARC record")
        whole: list[bytes] = []

        def rest() -> bytes:
            if not whole:
                parts, left = [raw], z.unconsumed_tail
                while not z.eof:
                    left = left or f.read(total - len(start) if total and total > len(start) else 1 << 16)
                    if not left:
                        raise ValueError("a record is cut short")
                    parts.append(z.decompress(left))
                    left = z.unconsumed_tail
                whole.append(b"".join(parts))
            return whole[0]

        row = self.row(fields, lambda: rest()[head : head + int(fields["content-length"])])
        if total is None:  # other writers' files: the member's end is found by decoding
            rest()
            total = f.tell() - at - len(z.unused_data) if f.tell() > at + len(start) else len(start) - len(z.unused_data)
        return at + total, row


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.level = int(options.get("level", "1"))
        self.roll = int(options.get("maxFileBytes", str(1 << 30)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, f, size = [], None, 0
        try:
            for batch in iterator:
                rid, kind, uri, refers, sha1, body = (batch.column(c) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload"))
                for i in range(batch.num_rows):
                    payload = body[i].as_py() or b""
                    sha = sha1[i].as_py() or digest(payload)
                    raw = member(record(kind[i].as_py(), rid[i].as_py(), uri[i].as_py() or "", self.date, payload, sha, refers[i].as_py()), self.level)
                    if f is None or size > self.roll:
                        if f is not None:
                            f.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        f, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                    f.write(raw)
                    size += len(raw)
        finally:
            if f is not None:
                f.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m is not None for n in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                fs.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows for the writer: of equal payloads of at least ``min_bytes``, the largest id's is kept, the others revisit it."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"))
    # only ids and digests are grouped; a digest that many rows share is summed before the shuffle, and its join may be split
    keys = rows.filter(F.length("payload") >= min_bytes).select("id", F.sha1("payload").alias("sha"))
    first = keys.groupBy("sha").agg(F.max("id").alias("response"))
    again = keys.join(first, "sha").filter("id < response").distinct()
    marked = rows.withColumn("sha", F.sha1("payload")).join(again, ["id", "sha"], "left")
    return marked.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none"))).alias("record_id"),
        F.when(F.col("response").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("uri").alias("target_uri"),
        F.concat(F.lit("urn:page:"), F.col("response").cast("string")).alias("refers_to"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
        "payload",
    )


def warc_round_trip(pages: DataFrame, path: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes every page as a record, reads the archives back: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch(spark, "warc")
    archive_records(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_bytes=min_bytes).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("payload", "false").option("verify", "true").load(path)

    def number(c: str):
        return F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")

    return back.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
