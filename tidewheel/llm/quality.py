"""Quality rules: base counts of a text, and repetition by a suffix array over its words.

Suffixes of all documents of a slice are sorted together by prefix doubling (only groups
that still tie are sorted again); word classes differ between documents, so ties never cross
them. The ranks kept at each doubling give the longest common prefix of neighbours. A
suffix's longest repeat is the larger of its two neighbours' values, which is the value of
the deepest LCP interval that holds it: the union of those spans is the union of all
maximal repeated substrings' occurrences.

Defined results: null or wordless text has zero counts, fails the base rule and is not
kept; repeated rows are judged alike; very long texts are read whole; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _BYTE, Words, inverse, mix, powers, slices, split_words

_U = np.uint64
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LINE_BASE = 0xC2B2AE3D27D4EB4F


def suffix_array(w: Words) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffix order of all words, ranks at each doubling, and each document's end by word."""
    m = len(w.hash)
    stop = w.first[1:][w.doc]
    key = mix(w.hash ^ mix(w.doc.astype(_U) + _U(1)))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(m, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    rank = np.empty(m, np.int32)
    rank[order] = head
    ranks, step = [rank], 1
    size = np.diff(np.append(np.flatnonzero(new), m))
    tied = np.flatnonzero(np.repeat(size, size) > 1)  # places in the order
    while len(tied):
        at = order[tied]
        ahead = at + step
        second = np.where(ahead < stop[at], rank[np.minimum(ahead, m - 1)] + 1, 0)
        r = rank[at]
        by = np.lexsort((second, r))
        at, r, second = at[by], r[by], second[by]
        order[tied] = at
        new = np.ones(len(tied), bool)
        new[1:] = (r[1:] != r[:-1]) | (second[1:] != second[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        rank = rank.copy()
        rank[at] = tied[head]
        ranks.append(rank)
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        step *= 2
    return order, ranks, stop


def longest_repeats(w: Words) -> np.ndarray:
    """For each word, the length of the longest run from it that its document holds elsewhere, too."""
    m = len(w.hash)
    if m < 2:
        return np.zeros(m, np.int64)
    order, ranks, stop = suffix_array(w)
    pair = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
    x, y = order[pair], order[pair + 1]
    lcp = np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = x + lcp, y + lcp
        inside = np.flatnonzero((a < stop[x]) & (b < stop[y]))
        same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
        lcp[same] += 1 << level
    best = np.zeros(m, np.int64)
    np.maximum.at(best, x, lcp)
    np.maximum.at(best, y, lcp)
    return best


def _covered(w: Words, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Words of each document under the union of spans."""
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    under = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return under[w.first[1:]] - under[w.first[:-1]]


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def duplicate_lines(data: np.ndarray, off: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document. ``words``: bytes inside words."""
    n, docs = len(data), len(off) - 1
    if not n:
        return np.zeros(docs, np.int64)
    cut = np.flatnonzero(data == 10)
    full = off[:-1][np.diff(off) > 0]
    start = np.sort(np.concatenate([full, cut + 1]))
    end = np.sort(np.concatenate([cut, off[1:][np.diff(off) > 0]]))
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * powers(_LINE_BASE, n), out=total[1:])
    inside = np.concatenate([[0], np.cumsum(words)])
    ok = inside[end] > inside[start]
    start, end = start[ok], end[ok]
    h = mix((total[end] - total[start]) * powers(inverse(_LINE_BASE), n)[start] + (end - start).astype(_U))
    doc = np.searchsorted(off, start, "right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][again], minlength=docs)


def figures(data: np.ndarray, off: np.ndarray, min_repeat: int, max_percent: int, max_longest: int) -> list[np.ndarray]:
    """The columns of SCHEMA after the id, for one slice."""
    w = split_words(data, off)
    word = np.zeros(len(data) + 1, np.int8)
    word[w.start] += 1
    word[w.end] -= 1
    word = np.cumsum(word[:-1], dtype=np.int8) > 0
    n = w.counts
    best = longest_repeats(w)
    rep = _covered(w, np.flatnonzero(best >= 3), 3)
    long = np.flatnonzero(best >= min_repeat)
    cover = _covered(w, long, best[long])
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, w.doc, best)
    # a maximal repeat starts where the repeat from the word before is no longer by one
    back = np.maximum(long - 1, 0)
    starts = long[(long == 0) | (best[back] != best[long] + 1) | (w.doc[back] != w.doc[long])]
    failed = (n < 50) | (100 * rep > 50 * n)
    kept = ~failed & (100 * cover <= max_percent * n) & (longest <= max_longest)
    return [n, _sums(word & ((data & 0xC0) != 0x80), off), _sums(_SYMBOL[data], off), duplicate_lines(data, off, word), rep, failed, cover, longest, np.bincount(w.doc[starts], minlength=len(n)), kept]


def _judge(min_repeat: int, max_percent: int, max_longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                cols = figures(data, off, min_repeat, max_percent, max_longest)
                yield pa.record_batch([part.column("doc"), *[pa.array(c) for c in cols]], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


SCHEMA = "doc long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_covered_words long, longest_repeat long, n_maximal_repeats long, kept boolean"


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 10, max_percent: int = 30, max_longest: int = 100) -> DataFrame:
    """One row per input row: base counts, repetition figures and ``kept``.

    Kept: the base rule holds, repeats of at least ``min_repeat`` words cover at most
    ``max_percent`` % of the words, and no repeat is longer than ``max_longest`` words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_judge(min_repeat, max_percent, max_longest), SCHEMA).withColumnRenamed("doc", id_col)


def _kept(text: str, min_repeat: int, max_percent: int, max_longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, text):
                yield part.filter(pa.array(figures(data, off, min_repeat, max_percent, max_longest)[-1]))

    return run


def keep_quality(docs: DataFrame, *, text_col: str = "text", min_repeat: int = 10, max_percent: int = 30, max_longest: int = 100) -> DataFrame:
    """The input rows that ``quality_rules`` keeps, with all their columns and without a shuffle."""
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any names will do
    text = rows.columns[docs.columns.index(text_col)]
    return rows.mapInArrow(_kept(text, min_repeat, max_percent, max_longest), rows.schema).toDF(*docs.columns)
