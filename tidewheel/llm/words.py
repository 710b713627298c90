"""Vectorised words and hashes over Arrow string batches.

A word is a run of bytes other than space and 0x09-0x0D. All functions work on
one flat byte array of a slice of documents, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) | _U(1)
_BYTE_FOLD = _BYTE.copy()
_BYTE_FOLD[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_BYTE_2 = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) | _U(1)
_BASE_2 = 0xE7037ED1A0B428DB
_GRAM_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, _U(base & (1 << 64) - 1))
        have[0] = _U(1)
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near values spread over all bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass
class Words:
    """Words of a slice: byte bounds in ``data``, document index, 64-bit hash; ``first[d]`` is document d's first word."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    total: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words of over n bytes, and hashes of their first n bytes."""
        at = np.flatnonzero(self.end - self.start > n)
        s = self.start[at]
        h = (self.total[s + n] - self.total[s]) * powers(inverse(_BASE), len(self.data))[s]
        return at, mix(h ^ mix(np.full(1, n, _U)))


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings in a row and the n + 1 offsets; null is empty."""
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def split_words(data: np.ndarray, off: np.ndarray, fold: bool = False, space: np.ndarray = _SPACE) -> Words:
    """Words of the documents that ``off`` delimits in ``data``; ``fold`` hashes A-Z as a-z; ``space``: bytes between words."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, off, z, z, z, np.zeros(0, _U), np.zeros(len(off), np.int64), np.zeros(1, _U))
    inside = ~space[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = ~inside[:-1]
    starts = inside & edge[:-1]
    cut = off[1:-1]
    cut = cut[cut < n]
    starts[cut] = inside[cut]
    start = np.flatnonzero(starts)
    ends = np.zeros(n + 1, bool)
    ends[1:n] = inside[:-1] & ~inside[1:]
    ends[n] = inside[-1]
    back = cut[cut > 0]
    ends[back] |= inside[back - 1]
    end = np.flatnonzero(ends)
    total = np.zeros(n + 1, _U)
    np.cumsum((_BYTE_FOLD if fold else _BYTE)[data] * powers(_BASE, n), out=total[1:])
    h = (total[end] - total[start]) * powers(inverse(_BASE), n)[start]
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(data, off, start, end, doc, mix(h + (end - start).astype(_U)), first, total)


def bounded(w: Words, start: np.ndarray, end: np.ndarray) -> Words:
    """Words between other bounds, ascending and each within one document."""
    h = (w.total[end] - w.total[start]) * powers(inverse(_BASE), len(w.data))[start]
    first = np.searchsorted(start, w.offsets)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return replace(w, start=start, end=end, doc=doc, hash=mix(h + (end - start).astype(_U)), first=first)


def second_hashes(w: Words) -> Words:
    """``w`` with word hashes from byte values and a base of their own."""
    n = len(w.data)
    if n == 0:
        return w
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_2[w.data] * powers(_BASE_2, n), out=total[1:])
    h = (total[w.end] - total[w.start]) * powers(inverse(_BASE_2), n)[w.start]
    return replace(w, hash=mix(h ^ (w.end - w.start).astype(_U)), total=total)


def grams(w: Words, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all runs of n words within one document, and their hashes."""
    m = len(w.hash)
    if m < n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    base = _GRAM_BASES[which]
    total = np.zeros(m + 1, _U)
    np.cumsum(w.hash * powers(base, m), out=total[1:])
    pos = np.flatnonzero(w.doc[n - 1 :] == w.doc[: m - n + 1])
    return pos, mix((total[pos + n] - total[pos]) * powers(inverse(base), m)[pos])


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of whole rows with about ``limit`` bytes of text (one row at least)."""
    data, off = flat(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to
