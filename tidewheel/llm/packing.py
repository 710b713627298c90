"""Packing of tokenised documents into sequences of a fixed window.

A document's ids (and an end id) are cut at the window; its full windows are sequences by
themselves. The rest of each document waits in a buffer of at most ``buffer`` pieces. For a
full buffer, lengths are put into bins, all combinations of at most ``depth`` bins that fill
the window are listed, and non-negative least squares finds how often to use each so that
the buffer's length histogram is met. Counts are rounded down; what is left is packed
greedily, longest first, cutting a piece only where a gap of ``min_cut`` or more ids would
stay open. A task's last, part-filled sequence is cut at powers of two, which need no padding.

Each task packs its own rows: no shuffle, memory bounded by the buffer, and a task run
again gives the same sequences. Defined results: null text is empty and gives the end id
alone; repeated rows are packed each for itself; a null id is carried along; very long texts are
cut into windows; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Of byte_bpe_50k.json; the rank file of the vocabulary leaves it out.
ADDED_TOKENS = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


@lru_cache(maxsize=4)
def combinations(bins: int, depth: int) -> np.ndarray:
    """Each column: how often each of the bins 1..bins occurs in one combination that sums to ``bins``."""
    found = []
    for k in range(1, depth + 1):
        for head in combinations_with_replacement(range(1, bins + 1), k - 1):
            last = bins - sum(head)
            if last >= (head[-1] if head else 1):
                found.append([*head, last])
    a = np.zeros((bins, len(found)))
    for j, c in enumerate(found):
        np.add.at(a[:, j], np.array(c) - 1, 1)
    return a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min ||a x - b|| over x >= 0 by an active set (Lawson and Hanson)."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    for _ in range(rounds):
        slope = atb - ata @ x
        slope[used] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-7 * max(1.0, float(b.max())):
            break
        used[j] = True
        while True:
            on = np.flatnonzero(used)
            s = np.linalg.lstsq(ata[np.ix_(on, on)], atb[on], rcond=None)[0]
            if s.min() > 1e-12:
                x[:] = 0
                x[on] = s
                break
            low = s <= 1e-12
            t = np.min(x[on][low] / np.maximum(x[on][low] - s[low], 1e-30))
            x[on] += t * (s - x[on])
            gone = on[low & (x[on] <= 1e-9)]
            used[gone if len(gone) else on[low]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


class Packer:
    """Pieces are (document number, start, ids)."""

    def __init__(self, window: int, bins: int, depth: int, min_cut: int):
        self.window, self.bins, self.depth, self.min_cut = window, bins, depth, min_cut
        self.step = window // bins
        self.waiting: list[tuple] = []

    def pack(self, last: bool) -> Iterator[list[tuple]]:
        """Sequences (lists of pieces) from what waits; unless ``last``, a part-filled one goes on waiting."""
        pieces = sorted(self.waiting, key=lambda p: (len(p[2]), p[0]))
        self.waiting = []
        shelf: list[list[tuple]] = [[] for _ in range(self.bins + 1)]
        for p in pieces:
            shelf[-(-len(p[2]) // self.step)].append(p)
        table = combinations(self.bins, self.depth)
        counts = np.floor(nnls(table, np.array([len(s) for s in shelf[1:]], float)) + 1e-6).astype(int)
        opened: list[list[tuple]] = []
        for j in np.flatnonzero(counts):
            need = table[:, j].astype(int)
            at = np.flatnonzero(need)
            for _ in range(counts[j]):
                if any(len(shelf[b + 1]) < need[b] for b in at):
                    break
                opened.append([shelf[b + 1].pop() for b in at for _ in range(need[b])])
        rest = [p for s in shelf for p in s]  # ascending by length
        lengths = [len(p[2]) for p in rest]
        open_at = 0
        while open_at < len(opened) or rest:
            if open_at < len(opened):
                seq = opened[open_at]
                open_at += 1
            else:
                seq = [rest.pop()]
                lengths.pop()
            gap = self.window - sum(len(p[2]) for p in seq)
            while gap and (rest or gap >= self.min_cut and open_at < len(opened)):
                if not rest:  # the last combination is taken apart to fill the others
                    rest = sorted(opened.pop(), key=lambda p: len(p[2]))
                    lengths = [len(p[2]) for p in rest]
                i = bisect_right(lengths, gap) - 1
                if i >= 0 and (lengths[i] == gap or gap - lengths[i] < self.min_cut or i > 0 or lengths[i] * 2 > gap):
                    p = rest.pop(i)
                    lengths.pop(i)
                elif gap >= self.min_cut:
                    doc, start, ids = rest.pop()
                    lengths.pop()
                    p = (doc, start, ids[:gap])
                    if len(ids) > gap:
                        left = (doc, start + gap, ids[gap:])
                        k = bisect_left(lengths, len(left[2]))
                        rest.insert(k, left)
                        lengths.insert(k, len(left[2]))
                else:
                    break
                seq.append(p)
                gap -= len(p[2])
            if gap >= self.min_cut and not rest:
                if not last:
                    self.waiting.extend(seq)
                    continue
                yield from self.powers(seq)
            else:
                yield seq

    def powers(self, seq: list[tuple]) -> Iterator[list[tuple]]:
        """The pieces laid end to end and cut where the lengths of the parts are powers of two."""
        total = sum(len(p[2]) for p in seq)
        part, room = [], 1 << (total.bit_length() - 1)
        for doc, start, ids in seq:
            while len(ids):
                take = ids[:room]
                part.append((doc, start, take))
                start, ids = start + len(take), ids[len(take) :]
                room -= len(take)
                total -= len(take)
                if not room:
                    yield part
                    part, room = [], 1 << max(0, total.bit_length() - 1)


def _pack(path: str, pattern: str, added: tuple[tuple[str, int], ...], end_id: int, window: int, bins: int, depth: int, min_cut: int, buffer: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern, added)
        packer = Packer(window, bins, depth, min_cut)
        known: dict[int, tuple] = {}  # document number -> (id, tokens), for what waits
        number, sequence = 0, TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def put(seq: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids in seq:
                doc_id, total = known[doc]
                raw = np.ascontiguousarray(ids, "<u4")
                rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw.astype(np.int64) if with_ids else None))
                offset += len(ids)
            sequence += 1

        def out() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)] + ([pa.array([r[7] for r in rows], pa.list_(pa.int64()))] if with_ids else [])
            rows.clear()
            return pa.record_batch(cols, [x.split()[0] for x in SCHEMA.split(", ")] + (["ids"] if with_ids else []))

        for batch in batches:
            ids_in = batch.column("doc").to_pylist()
            for doc_id, text in zip(ids_in, batch.column("text")):
                ids = np.append(enc.encode_to_numpy(text.as_py() or "", allowed_special="all"), np.uint32(end_id))
                known[number] = (doc_id, len(ids))
                full = len(ids) // window * window
                for at in range(0, full, window):
                    put([(number, at, ids[at : at + window])])
                if full < len(ids):
                    packer.waiting.append((number, full, ids[full:].copy()))
                else:
                    known.pop(number)
                number += 1
                if len(packer.waiting) >= buffer:
                    for seq in packer.pack(last=False):
                        put(seq)
                    known = {p[0]: known[p[0]] for p in packer.waiting}
                if len(rows) >= 20_000:
                    yield out()
        for seq in packer.pack(last=True):
            put(seq)
        if rows:
            yield out()

    return run


def pack_sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, added_tokens: dict[str, int] | None = None, end_id: int = 1, window: int = 2048, bins: int = 64, depth: int = 3, min_cut: int = 16, buffer: int = 8192, with_ids: bool = False) -> DataFrame:
    """One row per piece: which ids of which document, and where in which sequence they stand.

    ``vocabulary``: a byte-level BPE rank file that executors can read; ``pattern``: its word pattern;
    ``added_tokens``: strings that are one id wherever they stand in a text, as in tokenizers.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        added_tokens = ADDED_TOKENS if added_tokens is None else added_tokens
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    done = rows.mapInArrow(_pack(str(vocabulary), pattern, tuple((added_tokens or {}).items()), end_id, window, bins, depth, min_cut, buffer, with_ids), SCHEMA + (", ids array<long>" if with_ids else ""))
    return done.withColumnRenamed("doc_id", id_col)
