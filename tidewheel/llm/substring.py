"""Exact repeated-window removal behind a count-min prefilter.

1. Every partition counts the minimisers of its windows (the least hash among the
   ``gram``-word runs inside a window: equal windows share it, and distinct starts of one
   window have distinct minimiser starts, so a minimiser's count is never below the
   window's). The partitions' sparse sketches are summed per sketch chunk.
2. Windows whose estimate is two or more go on to an exact grouping; each start but the
   first is marked. A window estimated once occurs once, so nothing is lost. Successive
   windows of one minimiser travel as one row, dealt by the minimiser; where the sketch
   estimates ``HOT`` occurrences of it or more, each window travels by its own hash, so that
   only equal windows come together.

Hot windows: a task keeps only its own first start of a window for the grouping and marks
its later ones itself, so a window has at most a row for each task and flush. Partitions
are sorted by Spark and read as a stream; one key's rows are held at a time.

Windows are told apart by 64 bits beside an equal minimiser hash, hot ones by 128; the two
hashes have bases and byte values of their own, for words and for windows.

Defined results: null text has no words; a text under ``window`` words keeps all; a null id
comes after all others; rows with equal id and text are one document seen twice (neither is
earlier, both get the same result); rows with one id and different texts are ordered by a
hash of the text, null ids likewise. An empty table gives an empty result, a very long text
is read whole, other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_or_last, null_back
from .words import Words, flat, grams, mix, second_hashes, slices, split_words

WINDOW = 20
CHUNK_BITS = 20
ROWS = (0, 0x5851F42D4C957F2D)
FLUSH = 2_000_000
HOT = 128


def minimisers(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts (word index), the start of each window's minimiser and its hash."""
    pos, _ = grams(w, window)
    if not len(pos):
        return pos, pos, np.zeros(0, np.uint64)
    gpos, gh = grams(w, gram)
    h = np.full(len(w.hash), ~np.uint64(0))
    h[gpos] = gh
    # least (hash, leftmost) over window - gram + 1 starts, by doubling
    span, at, best = 1, np.arange(len(h)), h
    need = window - gram + 1
    while span < need:
        step = min(span, need - span)
        other, oat = best[step:], at[step:]
        take = other < best[:-step]
        best = np.concatenate([np.where(take, other, best[:-step]), best[-step:]])
        at = np.concatenate([np.where(take, oat, at[:-step]), at[-step:]])
        span += step
    return pos, at[pos], best[pos]


def _slot(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h ^ np.uint64(ROWS[row])) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(bits: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held)
            held.clear()
            for row in range(len(ROWS)):
                slot, n = np.unique(_slot(h, row, bits), return_counts=True)
                chunk = slot >> CHUNK_BITS
                cut = np.flatnonzero(np.diff(chunk)) + 1
                inner = (slot & ((1 << CHUNK_BITS) - 1)).astype(np.uint32)
                n = np.minimum(n, 255).astype(np.uint8)
                key = [(row << 20) + int(chunk[i]) for i in np.concatenate([[0], cut])]
                yield pa.record_batch([pa.array(key, pa.int32()), pa.array([x.tobytes() for x in np.split(inner, cut)], pa.binary()), pa.array([x.tobytes() for x in np.split(n, cut)], pa.binary())], ["chunk", "slots", "counts"])

        for batch in batches:
            for _, data, off in slices(batch, "text"):
                _, at, h = minimisers(split_words(data, off), window, gram)
                if len(at):
                    held.append(h[np.concatenate([[True], at[1:] != at[:-1]])])
            if sum(map(len, held)) > FLUSH:
                yield from out()
        if held:
            yield from out()

    return run


def _merge(hot: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums the sketches of one chunk; keeps two bits a counter: two or more, ``hot`` or more."""
        seen = np.zeros(1 << CHUNK_BITS, np.uint8)
        for slots, counts in zip(pdf["slots"], pdf["counts"]):
            at, n = np.frombuffer(slots, np.uint32), np.frombuffer(counts, np.uint8)
            seen[at] += np.minimum(n, 255 - seen[at])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [np.packbits(seen > 1).tobytes()], "hot": [np.packbits(seen >= hot).tobytes()]})

    return run


def repeated_bits(docs: DataFrame, bits: int, window: int, gram: int, hot: int) -> np.ndarray:
    """A bit array a sketch row (two or more) and one of the first row's hot counters; their size is fixed by ``bits`` whatever the corpus."""
    parts = docs.select("text").mapInArrow(_sketch(bits, window, gram), "chunk int, slots binary, counts binary")
    got = parts.groupBy("chunk").applyInPandas(_merge(hot), "chunk int, bits binary, hot binary").select("chunk", "bits", F.when(F.col("chunk") < 1 << 20, F.col("hot")).alias("hot")).collect()
    full = np.zeros((len(ROWS) + 1, 1 << (bits - 3)), np.uint8)
    for chunk, b, hot in got:
        row, i = chunk >> 20, (chunk & ((1 << 20) - 1)) << (CHUNK_BITS - 3)
        full[row, i : i + len(b)] = np.frombuffer(b, np.uint8)
        if hot is not None:
            full[-1, i : i + len(hot)] = np.frombuffer(hot, np.uint8)
    return full


MARKS = ["doc", "th", "pos", "run"]


def _mark_rows(doc: np.ndarray, th: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Starts as (doc, th, first pos, number of successive pos), sorted."""
    if not len(doc):
        return [doc, th, pos, np.zeros(0, np.int32)]
    order = np.lexsort((pos, th, doc))
    doc, th, pos = doc[order], th[order], pos[order]
    at = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(th) != 0) | (np.diff(pos) != 1)]))
    return [doc[at], th[at], pos[at], np.diff(np.append(at, len(doc))).astype(np.int32)]


def _first_marks(k, h, doc, th, pos) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by window, then start; and which sorted rows start later than their window's first."""
    order = np.lexsort((pos, th, doc, h, k))
    k, h, doc, th, pos = (x[order] for x in (k, h, doc, th, pos))
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    return order, (doc != doc[head]) | (th != th[head]) | (pos != pos[head])


def _bit(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


CANDIDATES = "k long, h binary, doc long, th long, pos long, run int"


def _candidates(shared, window: int, gram: int):
    """Windows estimated repeated: a row for successive ones of one minimiser (``h``: their hashes, ``run`` 0);
    and runs of starts that the task itself knows to be later ones (``h`` null, ``run``: their number)."""
    names = ["k", "h", "doc", "th", "pos", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        width = int(bits.shape[1] * 8).bit_length() - 1
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            k, h, doc, th, pos, hot = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, later = _first_marks(k, h, doc, th, pos)
            d, t, p, n = _mark_rows(doc[order[later]], th[order[later]], pos[order[later]])
            one = np.sort(order[~later])
            k, h, doc, th, pos, hot = (x[one] for x in (k, h, doc, th, pos, hot))
            at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (np.diff(pos) != 1) | hot[1:]]))
            ends = np.append(at, len(k)).astype(np.int32) * 8
            hashes = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(h))])
            yield pa.record_batch([pa.array(k[at].view(np.int64)), hashes, *[pa.array(x[at]) for x in (doc, th, pos)], pa.array(np.zeros(len(at), np.int32))], names)
            yield pa.record_batch([pa.array(mix((d ^ t).view(np.uint64)).view(np.int64)), pa.nulls(len(d), pa.binary()), pa.array(d), pa.array(t), pa.array(p), pa.array(n)], names)

        for batch in batches:
            for part, data, off in slices(batch, "text"):
                w = split_words(data, off)
                pos, _, least = minimisers(w, window, gram)
                keep = np.ones(len(pos), bool)
                for row in range(len(ROWS)):
                    keep &= _bit(bits[row], _slot(least, row, width))
                if not keep.any():
                    continue
                hit, least, d = pos[keep], least[keep], w.doc[pos[keep]]
                hot = _bit(bits[-1], _slot(least, 0, width))
                k = np.where(hot, mix(grams(w, window)[1][keep] ^ np.uint64(1)), least)
                h = grams(second_hashes(w), window, 1)[1][keep]
                ids, texts = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "th"))
                held.append((k, h, ids[d], texts[d], hit - w.first[d], hot))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield from out()
        if held:
            yield from out()

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact grouping: runs of later starts. Rows come sorted by key and only the last key's are held."""

    def out(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        h = t.column("h").chunk(0)
        ends = np.frombuffer(h.buffers()[1], np.int32)[h.offset : h.offset + len(h) + 1]
        n = np.diff(ends) // 8
        hashes = np.frombuffer(h.buffers()[2], np.uint64, int(n.sum()), int(ends[0])) if n.sum() else np.zeros(0, np.uint64)
        k, doc, th, pos = (np.repeat(t.column(c).to_numpy(), n) for c in ("k", "doc", "th", "pos"))
        pos = pos + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
        order, later = _first_marks(k, hashes, doc, th, pos)
        at = order[later]
        return pa.record_batch([pa.array(x) for x in _mark_rows(doc[at], th[at], pos[at])], MARKS)

    held: pa.Table | None = None
    for b in batches:
        done = b.column("h").is_null()
        yield b.filter(done).select(MARKS)
        t = pa.Table.from_batches([b.filter(b.column("h").is_valid())])
        t = pa.concat_tables([held, t]) if held is not None else t
        if t.num_rows:
            k = t.column("k").to_numpy()
            last = int(np.searchsorted(k, k[-1]))
            if last:
                yield out(t.slice(0, last))
            held = t.slice(last)
    if held is not None and held.num_rows:
        yield out(held)


def _clean(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            n_words, n_removed, sha, kept = [], [], [], []
            for i, spans in enumerate(batch.column("marks")):
                raw = data[off[i] : off[i + 1]].tobytes()
                words = raw.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if spans.is_valid and len(spans):
                    pos, run = (spans.values.field(k).to_numpy().astype(np.int64) for k in ("pos", "run"))
                    np.add.at(gone, pos, 1)
                    np.add.at(gone, pos + run - 1 + window, -1)
                    off_words = np.cumsum(gone)[:-1] > 0
                    left = b" ".join([x for x, g in zip(words, off_words.tolist()) if not g])
                    n_removed.append(int(off_words.sum()))
                else:
                    left = b" ".join(words)
                    n_removed.append(0)
                n_words.append(len(words))
                sha.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left.decode())
            cols = [batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.record_batch(cols + ([pa.array(kept, pa.string())] if with_text else []), ["doc", "n_words", "n_removed", "kept_sha256"] + (["kept_text"] if with_text else []))

    return run


def remove_repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = 10, sketch_bits: int | None = None, max_sketch_bits: int = 29, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (and kept_text on request).

    ``sketch_bits``: log2 of the counters in each of the two sketch rows; by default from the
    corpus' size, up to ``max_sketch_bits`` (three bit arrays of 64 MB are then broadcast). A
    sketch too narrow only lets more windows through to the exact grouping: at most 8 bytes a
    word and some 40 a minimiser are then shuffled. ``hot`` (255 at most): see above.
    """
    spark = docs.sparkSession
    rows = docs.select(id_or_last(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    if sketch_bits is None:
        chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        sketch_bits = min(max_sketch_bits, max(CHUNK_BITS, (chars // 4).bit_length()))
    bits = repeated_bits(rows, max(CHUNK_BITS, sketch_bits), window, gram, hot)
    shared = spark.sparkContext.broadcast(bits)
    found = rows.mapInArrow(_candidates(shared, window, gram), CANDIDATES)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = found.repartition(parts, "k").sortWithinPartitions("k").mapInArrow(_later, "doc long, th long, pos long, run int")
    # rows equal in id and text have equal marks: one of each
    marks = marks.groupBy("doc", "th").agg(F.collect_set(F.struct("pos", "run")).alias("marks"))
    joined = rows.join(marks, ["doc", "th"], "left").select("doc", "text", "marks")
    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    done = joined.mapInArrow(_clean(window, with_text), schema)
    return done.select(null_back("doc").alias(id_col), *done.columns[1:])
