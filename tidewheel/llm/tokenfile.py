"""Token ids in seekable binary files, as a PySpark data source, and a round trip of a whole table.

A file is a row of independent zstandard frames of about ``frameBytes`` of ids (little-endian unsigned
integers of two or four bytes), then a skippable frame with an index of the documents, then the
trailing seek table of zstandard's seekable format: compressed and plain size of each frame and the low 32
bits of its content's XXH64. Any zstandard decoder can read such a file from end to end; a reader that
wants some documents finds them in the index and decompresses only the frames that hold them.
A document longer than a frame goes on in the next ones, so a writer holds one frame.

Writing: each task streams rows into one file of its own; a committed job's files go into a manifest in
the order of their tasks, with numbers of documents and ids and the least and largest document, so what
a lost or repeated task left is never read. Reading: one partition a file; comparisons of
doc_id are pushed down to files, documents and frames. Every frame read is checked.

Defined results of the round trip: null text is empty and has the end id alone; null ids come last;
repeated rows are documents of their own (equal ids go by a hash of their text; rows equal in both are
alike); an empty table gives an empty result; texts of any length are written whole; other columns
of the input are not read. Rows are dealt by ranges of (id, text hash, a row number), so
an id that a third of the rows share is spread over tasks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import scratch
from .warc import filesystem
from .words import Words, bounded, second_hashes, slices, split_words

MANIFEST = "_committed"
#: Fixed values of zstandard's skippable frames and of its seekable format.
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
_COLUMNS = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
#: Fixed value: the pattern of the tokenizer that the short way knows.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Runs of Latin letters, digits and ASCII signs, which normalising leaves as they are but for capitals, and the pattern on them.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[!-~{_LATIN}]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\\[-`{-~]+")
#: The same by bytes: the kind of each (a run of other bytes is not parted, nor is one with an apostrophe, which may start a part before letters), and its small letter.
_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[[ord("'"), 0x97, 0xB7]] = _OTHER  # after 0xC3 the last two are signs that are not ASCII
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[[*range(0x41, 0x5B), *range(0x80, 0x9F)]] += 0x20  # after 0xC3


class Encoder:
    """Ids of texts: those of the tokenizer, which only sees what has not been looked up before.

    White space never enters a token. A run of other characters that is plain and without an apostrophe is
    parted by kind of character, as the tokenizer's own pattern does, in small letters; any other run is one
    piece. Each piece is encoded once and then found by its 128-bit hash in a table of ``slots`` places, where
    a new one takes the place of an older one. Parts go to the tokenizer's model; other plain runs are parted
    by the pattern first; all others go the tokenizer's whole way.
    """

    def __init__(self, path: str, end_id: int, slots: int = 1 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in setup["added_tokens"]]
        lower = any(n.get("type") == "Lowercase" for n in (setup.get("normalizer") or {}).get("normalizers", []))
        self.short = lower and json.dumps(_PATTERN)[1:-1] in json.dumps(setup.get("pre_tokenizer") or {})
        of_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.latin = str.maketrans({c: of_bytes(c)[0][0] for c in map(chr, range(0xC0, 0x100))})
        self.model = self.tokenizer.model
        self.end_id, self.slots = end_id, slots
        self.hash, self.hash2 = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.at = np.zeros(slots, np.int64)
        self.parts: dict[str, list[int]] = {}
        self.ids, self.n_ids = np.array([end_id], np.uint32), 1
        self.first, self.size, self.n = np.zeros(1, np.int64), np.ones(1, np.int64), 1

    def part(self, p: str) -> list[int]:
        return [t.id for t in self.model.tokenize(p if p.isascii() else p.translate(self.latin))]

    def known_part(self, p: str) -> list[int]:
        found = self.parts.get(p)
        if found is None:
            found = self.parts[p] = self.part(p)
        return found

    def whole(self, runs: list[str]) -> list[list[int]]:
        """Ids of runs that are not parted yet."""
        plain = [self.short and _PLAIN.fullmatch(r) is not None and not any(a in r for a in self.added) for r in runs]
        other = iter(self.tokenizer.encode_batch_fast([r for r, ok in zip(runs, plain) if not ok], add_special_tokens=False))
        return [[i for p in _PARTS.findall(r.lower()) for i in self.known_part(p)] if ok else next(other).ids for r, ok in zip(runs, plain)]

    def append(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of new pieces, whose ids follow each other, among all that are held; arrays grow by doubling."""
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        if self.n + len(size) > len(self.size):
            more = np.zeros(max(len(self.size), len(size)), np.int64)
            self.first, self.size = np.concatenate([self.first, more]), np.concatenate([self.size, more])
        places = np.arange(self.n, self.n + len(size))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[places], self.size[places] = self.n_ids + np.cumsum(size) - size, size
        self.n_ids, self.n = self.n_ids + len(ids), self.n + len(size)
        return places

    def compact(self) -> None:
        """Drops what no place of the table leads to any more."""
        live = np.flatnonzero(self.at)
        size = self.size[self.at[live]]
        ids = self.ids[spans(self.first[self.at[live]], size)]
        self.n_ids = self.n = 1
        self.at[live] = self.append(ids, size)

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
        """What is looked up, and which of it are parts."""
        if not self.short:
            w = split_words(data, off)
            return w, np.zeros(len(w.start), bool)
        kind, raw = _KIND[data], data.tobytes()
        for a in self.added:
            at = raw.find(a.encode())
            while at >= 0:
                kind[at] = _OTHER
                at = raw.find(a.encode(), at + 1)
        w = split_words(_SMALL[data], off)
        odd = np.zeros(len(w.start), bool)
        odd[np.searchsorted(w.start, np.flatnonzero(kind == _OTHER), "right") - 1] = True
        if odd.any():  # these runs keep their capitals
            inside = spans(w.start[odd], w.end[odd] - w.start[odd])
            small = w.data
            small[inside] = data[inside]
            w = split_words(small, off)
        cut = np.flatnonzero(((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & (kind[1:] != 0) & (kind[:-1] != 0)) + 1
        run = np.searchsorted(w.start, cut, "right") - 1
        cut = cut[~odd[run] & (w.start[run] != cut)]
        start, end = np.sort(np.concatenate([w.start, cut])), np.sort(np.concatenate([w.end, cut]))
        return bounded(w, start, end), ~odd[np.searchsorted(w.start, start, "right") - 1]

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts that ``off`` delimits in ``data``, an end id after each text's, and the offsets of texts among ids."""
        if self.n > 2 * self.slots:
            self.compact()
        if len(self.parts) > self.slots // 4:
            self.parts.clear()
        w, parted = self.pieces(data, off)
        h, h2 = w.hash, second_hashes(w).hash
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        found = np.where((self.hash[slot] == h) & (self.hash2[slot] == h2), self.at[slot], 0)
        miss = np.flatnonzero(found == 0)
        if len(miss):
            _, one, back = np.unique(np.column_stack([h[miss], h2[miss]]).view("V16").ravel(), return_index=True, return_inverse=True)
            raw, one = w.data.tobytes(), miss[one]
            by = np.argsort(~parted[one], kind="stable")  # parts first
            n_parts = int(parted[one].sum())
            new = [raw[a:b].decode() for a, b in zip(w.start[one[by]].tolist(), w.end[one[by]].tolist())]
            learned = [*map(self.part, new[:n_parts]), *self.whole(new[n_parts:])]
            size = np.fromiter(map(len, learned), np.int64, len(learned))
            places = np.empty(len(one), np.int64)
            places[by] = self.append(np.fromiter(chain.from_iterable(learned), np.uint32, int(size.sum())), size)
            found[miss] = places[back.ravel()]
            self.hash[slot[one]], self.hash2[slot[one]], self.at[slot[one]] = h[one], h2[one], places
        n = len(w.first) - 1
        which = np.zeros(len(found) + n, np.int64)  # 0 is the end id, after each text's pieces
        which[np.arange(len(found)) + w.doc] = found
        size = self.size[which]
        to = np.cumsum(size)
        ids = self.ids[spans(self.first[which], size)]
        return ids, np.concatenate([[0], to[w.first[1:] + np.arange(n)]])


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indexes first .. first + size - 1, span after span."""
    to = np.cumsum(size)
    return np.repeat(first - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    return Encoder(path, end_id)


def _encode(path: str, end_id: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        kind = np.dtype(f"<u{id_bytes}")
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                ids, at = encode(data, off)
                if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                    raise ValueError(f"an id does not fit {id_bytes} bytes")
                raw = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((at * id_bytes).astype(np.int64)), pa.py_buffer(ids.astype(kind))])
                yield pa.record_batch([part.column("doc"), raw.cast(pa.binary())], ["doc_id", "ids"])

    return run


def encode_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, id_bytes: int = 2) -> DataFrame:
    """Rows (doc_id, ids: little-endian unsigned integers of ``id_bytes`` bytes, ``end_id`` last), in the order of the input."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(str(tokenizer), end_id, id_bytes), "doc_id long, ids binary")


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class FrameWriter:
    """Ids in frames, then the index and the seek table."""

    def __init__(self, out, id_bytes: int, frame_bytes: int, level: int):
        import zstandard

        self.out, self.id_bytes, self.frame_bytes = out, id_bytes, max(id_bytes, frame_bytes // id_bytes * id_bytes)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.counts: list[int] = []

    def put(self, doc: int | None, ids: memoryview) -> None:
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.counts.append(len(ids) // self.id_bytes)
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.frame_bytes - len(self.waiting))
            self.waiting += ids[at : at + take]
            at += take
            if len(self.waiting) == self.frame_bytes:
                self.flush()

    def flush(self) -> None:
        import xxhash

        if self.waiting:
            plain = bytes(self.waiting)
            packed = self.zstd.compress(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.waiting.clear()

    def close(self) -> None:
        self.flush()
        plain = struct.pack("<QI", len(self.docs), self.id_bytes) + np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.counts, "<u8").tobytes()
        index = skippable(INDEX_MAGIC, struct.pack("<I", zlib.crc32(plain)) + self.zstd.compress(plain))
        self.out.write(index)
        entries = [*self.frames, (len(index), 0, 0)]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, SEEK_END)
        self.out.write(skippable(SEEK_MAGIC, table))


class FrameReader:
    """The documents of one file; ``decoded`` counts the frames that were decompressed."""

    def __init__(self, f, size: int):
        import zstandard

        self.f, self.zstd, self.decoded = f, zstandard.ZstdDecompressor(), 0
        n, _, end = struct.unpack("<IBI", self._at(size - 9, 9))
        if end != SEEK_END:
            raise ValueError("no seek table")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.begin, self.packed, self.check = begin[:-2], table[:-1, 0], table[:-1, 2]
        self.plain = np.concatenate([[0], np.cumsum(table[:-1, 1])])
        raw = self._at(int(begin[-2]), int(table[-1, 0]))
        body = self.zstd.decompress(raw[12:])
        if struct.unpack("<I", raw[8:12])[0] != zlib.crc32(body):
            raise ValueError("the index is damaged")
        count, self.id_bytes = struct.unpack("<QI", body[:12])
        self.docs = np.frombuffer(body, "<i8", count, 12)
        self.nulls = np.frombuffer(body, "u1", count, 12 + 8 * count).astype(bool)
        self.counts = np.frombuffer(body, "<u8", count, 12 + 9 * count).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self._kept: tuple[int, bytes] = (-1, b"")

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        if self._kept[0] != k:
            plain = self.zstd.decompress(self._at(int(self.begin[k]), int(self.packed[k])))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.check[k]:
                raise ValueError(f"frame {k} is damaged")
            self.decoded += 1
            self._kept = (k, plain)
        return self._kept[1]

    def ids(self, i: int) -> bytes:
        """Document i's ids as they are stored."""
        at, end = int(self.starts[i]) * self.id_bytes, int(self.starts[i] + self.counts[i]) * self.id_bytes
        parts = []
        k = int(np.searchsorted(self.plain, at, "right")) - 1
        while at < end:
            base, to = int(self.plain[k]), min(end, int(self.plain[k + 1]))
            parts.append(self.frame(k)[at - base : to - base])
            at, k = to, k + 1
        return b"".join(parts)


@dataclass
class FilePartition(InputPartition):
    path: str
    first: int

    def __init__(self, path: str, first: int):
        super().__init__(path)
        self.path, self.first = path, first


def _fits(kind: str, value, low, high) -> bool:
    """Whether a value of low..high can meet the comparison."""
    return {"in": lambda: any(low <= v <= high for v in value), "gt": lambda: high > value, "ge": lambda: high >= value, "lt": lambda: low < value, "le": lambda: low <= value}[kind]()


class TokenReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.with_ids = options.get("ids", "true").lower() == "true"
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            if getattr(f, "attribute", None) == ("doc_id",) and isinstance(f, (EqualTo, In)):
                self.wanted.append(("in", [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]))
            elif getattr(f, "attribute", None) == ("doc_id",) and type(f) in kinds:
                self.wanted.append((kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, root = filesystem(self.path)
        found, first = [], 0
        names = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith(MANIFEST))
        for name in names:
            with fs.open_input_stream(name) as f:
                entries = json.loads(f.read())
            for e in entries:
                if not self.wanted or e["low"] is not None and all(_fits(k, v, e["low"], e["high"]) for k, v in self.wanted):
                    found.append(FilePartition(f"{self.path.rstrip('/')}/{e['name']}", first))
                first += e["tokens"]
        return found

    def _which(self, r: FrameReader) -> np.ndarray:
        ok = np.ones(len(r.docs), bool)
        for kind, v in self.wanted:
            ok &= ~r.nulls & {"in": lambda: np.isin(r.docs, v), "gt": lambda: r.docs > v, "ge": lambda: r.docs >= v, "lt": lambda: r.docs < v, "le": lambda: r.docs <= v}[kind]()
        return np.flatnonzero(ok)

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        fs, path = filesystem(partition.path)
        with fs.open_input_file(path) as f:
            r = FrameReader(f, f.size())
            rows: list[tuple] = []
            held = 0

            def out() -> pa.RecordBatch:
                cols = dict(zip(_COLUMNS, zip(*rows)))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                batch = pa.record_batch([pa.array(cols[c], k) for c, k in zip(_COLUMNS, kinds)], _COLUMNS)
                rows.clear()
                return batch.select(self.columns)

            for i in self._which(r):
                ids = np.frombuffer(r.ids(int(i)), f"<u{r.id_bytes}").astype("<u4")
                rows.append((None if r.nulls[i] else int(r.docs[i]), partition.first + int(r.starts[i]), int(r.counts[i]), zlib.crc32(ids), ids.tobytes() if self.with_ids else None))
                held += ids.nbytes if self.with_ids else 0
                if len(rows) >= 10_000 or held >= 1 << 23:
                    yield out()
                    held = 0
            if rows:
                yield out()


@dataclass
class Written(WriterCommitMessage):
    task: int
    files: list[dict] = field(default_factory=list)


class TokenWriter(DataSourceArrowWriter):
    """Columns doc_id and ids, in the order in which they are to be read. Options: idBytes, frameBytes, level."""

    def __init__(self, options: dict):
        self.path = options["path"]  # names come in small letters
        self.id_bytes = int(options.get("idbytes", "4"))
        self.frame_bytes, self.level = int(options.get("framebytes", str(1 << 18))), int(options.get("level", "3"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        done = Written(TaskContext.get().partitionId())
        f = frames = None
        try:
            for batch in iterator:
                for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                    if frames is None:
                        name = f"part-{uuid.uuid4().hex}.ids.zst"
                        fs.create_dir(root, recursive=True)
                        f = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                        frames = FrameWriter(f, self.id_bytes, self.frame_bytes, self.level)
                    frames.put(doc, memoryview(ids.as_buffer() or b""))
            if frames is not None:
                frames.close()
                ids = [d for d, null in zip(frames.docs, frames.nulls) if not null]
                done.files.append({"name": name, "docs": len(frames.docs), "tokens": sum(frames.counts), "low": min(ids, default=None), "high": max(ids, default=None)})
        finally:
            if f is not None:
                f.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        entries = [e for m in sorted((m for m in messages if m is not None), key=lambda m: m.task) for e in m.files]
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(entries).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for e in m.files if m is not None else ():
                fs.delete_file(f"{root}/{e['name']}")


class TokenDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenDataSource)


def write_token_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, id_bytes: int = 2, frame_bytes: int = 1 << 18) -> None:
    """All texts' ids in files under ``path``, in ascending order of ids."""
    register(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_last("doc_id"), F.asc("hash")]
    dealt = keyed.repartitionByRange(*order, F.asc("row")).sortWithinPartitions(*order)
    encoded = encode_texts(dealt, tokenizer=tokenizer, end_id=end_id, id_bytes=id_bytes)
    encoded.write.format("tokens").mode("append").option("idBytes", id_bytes).option("frameBytes", frame_bytes).save(path)


def token_round_trip(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes every text's ids, reads the files back: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_token_files(docs, path, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id)
    back = spark.read.format("tokens").option("ids", "false").load(path)
    return back.select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32")
