"""Benchmark decontamination: passages within a word edit distance of benchmark items.

An item of two or more times ``PIECE`` words is cut into pieces of about that length: of n pieces one
has at most an n-th of the edits, wherever they stand, so recall does not fall with the item's
length. Pieces fall into length classes. At a document's word p, a window of the class' length is
embedded by CGK random walks: at each step the word under the walk is written down, and the
walk moves on if a random bit of (step, word) says so. Equal words keep two walks together,
and after an edit they tend to meet again, so few edits change few coordinates. Each of
``repeats`` walks samples ``coordinates`` of its steps into one key (bit-sampling LSH); where
a window shares a key with a piece, the whole item is verified by its exact edit distance to any
passage around (Myers' bit vectors). The steps are sampled over all of a walk.
``recall`` of the sampling at the distance limit is measured in the tests.

Before embedding, windows that cannot match are set aside without loss: a passage within k
edits of a piece starts with a benchmark word, holds at most k words that are none, and, as an
edit touches two word pairs, at most 2 k word pairs that no item has.

The item tables are broadcast in blocks of about ``block_items`` items and ``block_bytes`` bytes of text
at most (a pass over the documents for each), so a broadcast has a fixed bound. Documents are not shuffled.

Words are runs of letters and digits, A-Z as a-z. Defined results: null texts hold nothing; items
under ``min_words`` words are too short to tell and match nothing; repeated rows and items match
each for itself; a null id is carried along. An empty table gives an empty result; very long texts
are read whole; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import Words, flat, grams, mix, slices, split_words

_U = np.uint64
PIECE = 12
WALK = 1.5
_BETWEEN = np.ones(256, bool)
_BETWEEN[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _BETWEEN[_a:_b] = False


def words_of(data: np.ndarray, off: np.ndarray) -> Words:
    return split_words(data, off, fold=True, space=_BETWEEN)


def walks(words: np.ndarray, steps: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Keys (rows x repeats) of word windows (rows x length, 0 beyond an end).

    ``steps``: for each repeat, the sampled steps in order.
    """
    n, m = words.shape
    out = np.empty((n, len(seeds)), _U)
    padded = np.concatenate([words, np.zeros((n, 1), _U)], axis=1)
    rows = np.arange(n)
    last = int(steps.max()) if steps.size else 0
    for r, seed in enumerate(seeds):
        at = np.zeros(n, np.int64)
        key = np.full(n, seed)
        for j in range(last + 1):
            if j % 64 == 0:
                bits = mix(padded ^ mix(np.array([seed + _U(j + 1)])))
            here = padded[rows, at]
            if j in steps[r]:
                key = mix(key * _U(0x9E3779B97F4A7C15) + here)
            at += ((bits[rows, at] >> _U(j % 64)) & _U(1)).astype(np.int64)
            np.minimum(at, m, out=at)
        out[:, r] = key
    return out


def edit_distance(item: list[int], text: list[int], anywhere: bool = False) -> tuple[int, int]:
    """(distance, end) of the prefix of ``text`` (``anywhere``: of the passage in it) nearest to ``item``, by Myers' bit vectors."""
    m = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text, 1):
        eq = where.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | (not anywhere)) & full
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        best = min(best, (score, j))
    return best


def nearest_passage(item: list[int], text: list[int], limit: int) -> tuple[int, int, int] | None:
    """(distance, start, length) of the passage of ``text`` nearest to ``item``, if within ``limit``."""
    have = set(text)
    if sum(w not in have for w in item) > limit:  # each such word is an edit
        return None
    distance, end = edit_distance(item, text, anywhere=True)
    if distance > limit:
        return None
    _, length = edit_distance(item[::-1], text[:end][::-1])
    return distance, end - length, length


class Items:
    """One block of benchmark items, ready to be looked up."""

    def __init__(self, ids: list, data: np.ndarray, off: np.ndarray, min_words: int, percent: int, repeats: int, coordinates: int):
        w = words_of(data, off)
        self.ids, self.percent = ids, percent
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.vocabulary = np.unique(np.concatenate([x for x in self.words if len(x) >= min_words] or [np.zeros(0, _U)]))
        pos, pair = grams(w, 2)
        self.pairs = np.unique(pair)
        self.classes = []
        rng = np.random.default_rng(77)
        pieces = []  # item, first word, words, edits of the piece with fewest
        for i, x in enumerate(self.words):
            m, n = len(x), max(1, len(x) // PIECE)
            if m >= min_words:
                cut = [m * j // n for j in range(n + 1)]
                pieces += [(i, p, q - p, percent * m // 100 // n) for p, q in zip(cut[:-1], cut[1:])]
        table = np.array(pieces, np.int64).reshape(-1, 4)
        lo, longest = min_words, int(table[:, 2].max(initial=0))
        while lo <= longest:
            hi = max(lo, int(lo * 1.3) - 1)
            members = table[(table[:, 2] >= lo) & (table[:, 2] <= hi)]
            seeds = mix(np.arange(repeats, dtype=_U) + _U(lo << 20) + _U(1))
            reach = max(coordinates, int(WALK * lo))
            steps = np.sort(np.array([rng.choice(reach, coordinates, replace=False) for _ in range(repeats)]), axis=1)
            if len(members):
                keys = walks(np.array([self.words[i][p : p + lo] for i, p, _, _ in members.tolist()]), steps, seeds).T  # repeats x pieces
                order = np.argsort(keys, axis=1)
                self.classes.append((lo, int(members[:, 3].max()), steps, seeds, np.take_along_axis(keys, order, axis=1), members[:, :2][order]))
            lo = hi + 1

    def unknown(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Benchmark words, and running counts of words and of word pairs (by their first word) that are none."""

        def known(h: np.ndarray, table: np.ndarray) -> np.ndarray:
            return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h

        word = known(w.hash, self.vocabulary)
        pair = np.zeros(len(w.hash), bool)
        pos, h = grams(w, 2)
        both = word[pos] & word[np.minimum(pos + 1, len(word) - 1)]
        pair[pos[both]] = known(h[both], self.pairs)
        return word, np.concatenate([[0], np.cumsum(~word)]), np.concatenate([[0], np.cumsum(~pair)])

    def starts(self, w: Words, word: np.ndarray, words_off: np.ndarray, pairs_off: np.ndarray, lo: int, edits: int) -> np.ndarray:
        """Words where a passage near a piece of the class can start."""
        p = np.flatnonzero(word)
        least = max(1, lo - edits)
        p = p[p + least <= w.first[1:][w.doc[p]]]
        p = p[words_off[p + least] - words_off[p] <= edits]
        return p[pairs_off[p + least - 1] - pairs_off[p] <= 2 * edits]

    def search(self, w: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, first word, words, distance): the nearest passage of each document for each item."""
        if not self.classes or not len(w.hash):
            return
        unknown = self.unknown(w)
        best: dict[tuple[int, int], tuple] = {}
        for lo, edits, steps, seeds, keys, members in self.classes:
            found = self.starts(w, *unknown, lo, edits)
            for a in range(0, len(found), 4096):
                p = found[a : a + 4096]
                grid = p[:, None] + np.arange(lo)
                inside = grid < w.first[1:][w.doc[p]][:, None]
                windows = np.where(inside, w.hash[np.minimum(grid, len(w.hash) - 1)], _U(0))
                mine = walks(windows, steps, seeds)
                pairs = set()
                for r in range(len(seeds)):
                    x, y = np.searchsorted(keys[r], mine[:, r]), np.searchsorted(keys[r], mine[:, r], "right")
                    for i in np.flatnonzero(y > x).tolist():
                        pairs.update((int(w.doc[p[i]]), k, int(p[i]) - at) for k, at in members[r][x[i] : y[i]].tolist())
                for d, k, at in sorted(pairs):  # where the item would start without edits before the piece
                    item, first = self.words[k], int(w.first[d])
                    limit = self.percent * len(item) // 100
                    known = best.get((d, k), (1 << 60, 0, 0))
                    if known[0] == 0 and first + known[1] <= at:
                        continue
                    start = max(first, at - limit)
                    text = w.hash[start : min(max(start, at + len(item) + 2 * limit), int(w.first[d + 1]))]
                    near = nearest_passage(item.tolist(), text.tolist(), limit)
                    if near is not None:
                        best[d, k] = min(known, (near[0], start - first + near[1], near[2]))
        for (d, k), (distance, start, length) in sorted(best.items()):
            yield d, k, start, length, distance


SCHEMA = "doc long, item_id long, start long, length long, item_words long, distance long"


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for part, data, off in slices(batch, "text", 2 << 20):
                ids = part.column("doc").to_pylist()
                rows = [(ids[d], items.ids[k], start, length, len(items.words[k]), distance) for d, k, start, length, distance in items.search(words_of(data, off))]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 15, min_words: int = 5, repeats: int = 16, coordinates: int = 3, block_items: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document and item that it holds within ``percent`` % word edits: id, item_id, start, length (words), item_words, distance."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // block_items), -(-size // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    if blocks > 1:
        items = written(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "items")
    found = None
    for block in range(max(1, blocks)):
        got = (items.filter(F.col("block") == block) if blocks > 1 else items).orderBy("item", "text").toArrow()
        data, off = flat(got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string()))
        shared = spark.sparkContext.broadcast(Items(got.column("item").to_pylist(), data, off, min_words, percent, repeats, coordinates))
        part = rows.mapInArrow(_search(shared), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("doc", id_col)
