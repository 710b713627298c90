"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Symbols: 0 for runs of other than letters, else the small letter itself; eight neighbouring Han
characters, the Hangul syllables of one beginning, and the letters above U+FFFF of one block of 256
share a symbol. Order-4 counts of every labelled training text, of all languages, are summed by
Spark. Lower orders count distinct contexts, discounts come from the counts of counts; Spark groups
and joins all of that, too. Each order is kept as sorted hash arrays (keys and, beside them,
interpolated probabilities and back-off weights), looked up by binary search. Tasks write the arrays
in pieces of at most ``PIECE`` keys and map them into memory: in the shared folder if that is a
path, else the driver sends piece after piece to the executors as files.

A text gets the language of the lowest cross-entropy a character. Its score is the posterior
among languages; ``rejected`` marks texts that fit their language worse than all but
``reject_share`` of all its labelled training texts. Those are judged by counts that do not hold
them: by models of the other half of the training texts (copies of a text are in one half). The
limit of a language is the least one that at most ``reject_share`` of its rightly predicted texts
exceed, in steps of 1 / ``STEPS``. Languages of fewer than ``calibrate_from`` labelled texts have
no limit: their texts are never rejected.

Defined results: null text, or one without letters, is ``und`` with score 0, as is every text if
nothing can be learned; ties go to the first language in order; a null id counts as training data;
repeated rows count each. An empty table gives an empty result; very long texts are read whole;
columns other than id, text and language are not read.
"""

from __future__ import annotations

import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .words import slices

ORDER = 4
BITS = 14
CLASSES = 1 << BITS
ASTRAL = 14_336
PIECE = 1 << 20
FLUSH = 4_000_000
CACHE = 1 << 26
KNOWN = 1 << 20
STEPS = 1 << 20
CELL = 12


def _mark(c: int) -> int:
    """What a letter below 2 ** 16 counts as."""
    if 0x3400 <= c < 0xA000 or 0xF900 <= c < 0xFB00:
        return c >> 3 << 3
    if 0xAC00 <= c < 0xD7A4:
        return c - (c - 0xAC00) % 28
    return ord(chr(c).lower()[0])


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Symbol of each code point below 2 ** 16."""
    letters = [c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L"]
    t = np.zeros(1 << 16, np.uint16)
    _, rank = np.unique([_mark(c) for c in letters], return_inverse=True)
    t[letters] = rank + 1
    assert rank.max() + 1 < ASTRAL
    return t


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all characters, runs of 0 as one, each text after three 0s; and each text's start."""
    points = np.frombuffer("\n\n\n".join(["", *texts]).encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(points, 0xFFFF)
    c = _table()[low]
    for p in np.unique(points[points > 0xFFFF]):
        if unicodedata.category(chr(p))[0] == "L":
            c[points == p] = ASTRAL + min(int(p) >> 8, CLASSES - ASTRAL - 1)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(size + 3)])  # of each text's leading 0s
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    lead = start[:-1]
    keep[lead] = True
    for i in (1, 2):
        keep[lead + i] = True
    after = lead + 3
    after = after[after < len(c)]
    keep[after] &= c[after] != 0  # the text's own leading 0s add none
    at = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], at[start]


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Order-4 keys (the predicted symbol lowest) of all characters, and each text's bounds."""
    c, start = classes(texts)
    k = c.astype(np.int64)
    for back in range(1, ORDER):
        k[ORDER - 1 :] |= c[ORDER - 1 - back : len(c) - back].astype(np.int64) << BITS * back
    n = np.diff(start) - 3
    at = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(at[-1]) + np.repeat(start[:-1] + 3 - at[:-1], n)
    return k[index], at


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        for lang in sorted({x[0] for x in held}):
            k = np.concatenate([x[1] for x in held if x[0] == lang])
            n = np.concatenate([x[2] for x in held if x[0] == lang])
            u, inv = np.unique(k, return_inverse=True)
            yield pa.record_batch([pa.array([lang] * len(u)), pa.array(u), pa.array(np.bincount(inv, weights=n).astype(np.int64))], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for part, _, _ in slices(batch, "text"):
            lang, text = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for name in set(lang):
                k, _ = keys([t or "" for t, g in zip(text, lang) if g == name])
                held.append((name, *np.unique(k, return_counts=True)))
        if sum(len(x[1]) for x in held) > FLUSH:
            yield from out()
    yield from out()


class Model:
    """Per language and order: sorted keys with probabilities, and contexts with back-off weights, in pieces by key.

    ``files``: of each language and order the pieces' paths (a bare name: a file that Spark sent), keys and contexts.
    """

    def __init__(self, langs: list[str], files: list[list[list[tuple[str, int, int]]]]):
        self.langs, self.files = langs, files
        self.limits = np.full(len(langs), np.inf)

    def part(self, name: str) -> Model:
        """The models of the languages that begin with ``name``, without it."""
        mine = [i for i, g in enumerate(self.langs) if g.startswith(name)]
        return Model([self.langs[i].removeprefix(name) for i in mine], [self.files[i] for i in mine])

    def tables(self, i: int) -> list[list[tuple]]:
        return [[self._piece(*piece) for piece in pieces] for pieces in self.files[i]]

    @staticmethod
    def _piece(path: str, n: int, m: int) -> tuple:
        raw = np.memmap(path if os.path.isabs(path) else SparkFiles.get(path), np.int64, "r")
        return raw[:n], raw[n : 2 * n].view(np.float64), raw[2 * n : 2 * n + m], raw[2 * n + m :].view(np.float64)

    @staticmethod
    def fit(gram: np.ndarray, n: np.ndarray) -> list[list[tuple]]:
        """Tables of orders 1..4 from order-4 counts; what ``probabilities`` does for all languages at once."""
        counts = [(gram.astype(np.int64), n.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):  # how many different characters stand before
            low = counts[0][0] & ((1 << BITS * order) - 1)
            u, m = np.unique(low, return_counts=True)
            counts.insert(0, (u, m.astype(np.float64)))
        tables, below = [], None
        for order, (k, c) in enumerate(counts, 1):
            by = np.argsort(k)
            k, c = k[by], c[by]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, inv = np.unique(k >> BITS, return_inverse=True)
            total = np.bincount(inv, weights=c)
            back = d * np.bincount(inv) / total
            lower = 1 / CLASSES if below is None else Model.probability(below, k & ((1 << BITS * (order - 1)) - 1), order - 1)
            tables.append([(k, np.maximum(c - d, 0) / total[inv] + back[inv] * lower, context, back)])
            below = tables
        return tables

    @staticmethod
    def find(pieces: list[tuple], x: np.ndarray, key: int, value: int) -> np.ndarray:
        """The entry of column ``value`` where column ``key`` is x, NaN where it never is."""
        found = np.full(len(x), np.nan)
        which = np.searchsorted([piece[key][-1] for piece in pieces], x)  # the first piece that can hold it
        for i in np.unique(which[which < len(pieces)]):
            mine = np.flatnonzero(which == i)
            at = np.searchsorted(pieces[i][key], x[mine])
            hit = pieces[i][key][at] == x[mine]
            found[mine[hit]] = pieces[i][value][at[hit]]
        return found

    @staticmethod
    def probability(tables: list[list[tuple]], k: np.ndarray, order: int) -> np.ndarray:
        """P(last symbol | those before) of keys of ``order`` symbols."""
        p = np.full(len(k), 1 / CLASSES)
        for o in range(1, order + 1):
            x = k & ((1 << BITS * o) - 1)
            prob, back = Model.find(tables[o - 1], x, 0, 1), Model.find(tables[o - 1], x >> BITS, 2, 3)
            p = np.where(np.isnan(prob), np.where(np.isnan(back), 1.0, back) * p, prob)
        return p

    def log_rows(self, k: np.ndarray) -> np.ndarray:
        rows = np.empty((len(k), len(self.langs)), np.float32)
        for i in range(len(self.langs)):  # one language's files are mapped at a time
            rows[:, i] = np.log(self.probability(self.tables(i), k, ORDER))
        return rows


class Scorer:
    """Sums of log probabilities; rows of keys seen before are kept up to about ``CACHE`` bytes and ``KNOWN`` keys."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known = pd.Index(np.zeros(0, np.int64))
        self.logs = np.zeros((0, len(self.model.langs)), np.float32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probability of each text in each language, characters, and whether it has a letter."""
        k, at = keys(texts)
        rows = self.known.get_indexer(k)
        new = np.unique(k[rows < 0])
        if len(new):
            if self.logs.nbytes > CACHE or len(self.known) > KNOWN:
                self.clear()
                new = np.unique(k)
            self.known = self.known.append(pd.Index(new))
            self.logs = np.concatenate([self.logs, self.model.log_rows(new)])
            rows = self.known.get_indexer(k)
        n = np.diff(at)
        total = np.zeros((len(texts), len(self.model.langs)))
        full = np.flatnonzero(n)
        if len(full):
            for j in range(total.shape[1]):
                total[full, j] = np.add.reduceat(self.logs[:, j][rows].astype(np.float64), at[full])
        letters = np.concatenate([[0], np.cumsum((k & (CLASSES - 1)) != 0)])
        return total, n, letters[at[1:]] > letters[at[:-1]]


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model.langs else None
        limit = max(1 << 14, min(1 << 20, (1 << 25) // max(1, len(model.langs))))
        for batch in batches:
            for part, _, _ in slices(batch, "text", limit):
                texts = [t or "" for t in part.column("text").to_pylist()]
                if scorer is None:
                    lang, score, entropy, far = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
                else:
                    total, n, some = scorer(texts)
                    best = np.argmax(total, axis=1)
                    top = total[np.arange(len(texts)), best]
                    score = np.where(some, 1 / np.exp(np.minimum(total - top[:, None], 0)).sum(axis=1), 0.0)
                    entropy = np.where(some, -top / np.maximum(n, 1), np.nan)
                    far = some & (np.floor(entropy * STEPS) > model.limits[best])
                    lang = [model.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())]
                yield pa.record_batch([part.column("id"), part.column("held_out"), pa.array(lang), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(far)], ["id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def probabilities(grams: DataFrame) -> DataFrame:
    """Order-4 counts (lang, gram, n) -> lang, ord, key, p, back: interpolated probabilities of all orders, and their contexts' weights."""
    counts = [grams.select("lang", F.col("gram").alias("key"), "n")]
    for order in range(ORDER - 1, 0, -1):  # how many different characters stand before
        key = F.col("key").bitwiseAND(F.lit((1 << BITS * order) - 1))
        counts.insert(0, written(counts[0].groupBy("lang", key.alias("key")).agg(F.count("*").alias("n")), "continuations"))
    found, below = None, None
    for order, c in enumerate(counts, 1):
        c = c.withColumn("context", F.shiftright("key", BITS))
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = c.groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("d"))
        context = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        rows = c.join(context, ["lang", "context"]).join(discount, "lang").withColumn("back", F.col("d") * F.col("kinds") / F.col("total"))
        if below is None:
            rows = rows.withColumn("lower", F.lit(1 / CLASSES))
        else:
            lower = below.select("lang", F.col("key").alias("tail"), F.col("p").alias("lower"))
            rows = rows.withColumn("tail", F.col("key").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))).join(lower, ["lang", "tail"])
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("lower")
        below = written(rows.select("lang", F.lit(order).alias("ord"), "key", p.alias("p"), "back"), "order")
        found = below if found is None else found.unionByName(below)
    return found


def _pieces(folder: str | None):
    """Rows sorted by lang, ord and key -> pieces: written to ``folder``, or given back whole without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            key, p, back = (np.concatenate(x) for x in zip(*held))
            context, first = np.unique(key >> BITS, return_index=True)
            body, path = b"".join(x.tobytes() for x in (key, p, context, back[first])), None
            if folder:
                os.makedirs(folder, exist_ok=True)
                path = f"{folder}/{uuid.uuid4().hex}"
                with open(path, "wb") as f:
                    f.write(body)
                body = None
            yield pa.record_batch([pa.array([x], t) for x, t in zip((*of, int(key[0]), len(key), len(context), path, body), PIECES.types)], PIECES.names)
            held.clear()

        for batch in batches:
            lang, order, key, p, back = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "ord", "key", "p", "back"))
            cut = [0, *(np.flatnonzero((lang[1:] != lang[:-1]) | (order[1:] != order[:-1])) + 1).tolist(), len(key)]
            for a, b in zip(cut[:-1], cut[1:]):
                if a == b:
                    continue
                if held and (of != (lang[a], int(order[a])) or sum(len(x[0]) for x in held) + b - a > PIECE):
                    yield from out()
                of = lang[a], int(order[a])
                held.append((key[a:b], p[a:b], back[a:b]))
        if held:
            yield from out()

    return run


PIECES = pa.schema([("lang", pa.string()), ("ord", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("path", pa.string()), ("body", pa.binary())])


def model_files(grams: DataFrame) -> Model:
    """The arrays of all languages in files; the driver holds their names, and one piece at a time where it has to send them."""
    spark = grams.sparkSession
    folder = scratch(spark, "langid")
    shared = folder.startswith("file:") or "://" not in folder
    folder = "/" + folder.removeprefix("file:").lstrip("/") if shared else None
    rows = probabilities(written(grams, "grams")).repartitionByRange("lang", "ord", "key").sortWithinPartitions("lang", "ord", "key")
    pieces = written(rows.mapInArrow(_pieces(folder), "lang string, ord int, first long, n long, m long, path string, body binary"), "models")
    sent = None if shared else tempfile.mkdtemp(prefix="tidewheel-")
    found: dict[tuple[str, int], list[tuple]] = {}
    for r in pieces.collect() if shared else pieces.toLocalIterator():
        path = r.path
        if not shared:
            path = uuid.uuid4().hex
            with open(f"{sent}/{path}", "wb") as f:
                f.write(r.body)
            spark.sparkContext.addFile(f"{sent}/{path}")
        found.setdefault((r.lang, r.ord), []).append((r.first, path, r.n, r.m))
    langs = sorted({g for g, _ in found})
    return Model(langs, [[[x[1:] for x in sorted(found[g, o])] for o in range(1, ORDER + 1)] for g in langs])


def entropy_limits(fits: DataFrame, reject_share: float, calibrate_from: int) -> DataFrame:
    """Labelled texts' (id: label, lang_pred, cross_entropy) -> lang, limit in steps; no task holds more of a language than its steps."""
    step = F.when(F.col("id") == F.col("lang_pred"), F.floor(F.col("cross_entropy") * STEPS))
    counts = written(fits.groupBy(F.col("id").alias("lang"), step.alias("step"), F.shiftright(step, CELL).alias("cell")).agg(F.count("*").alias("n")), "calibration")
    right = F.sum(F.when(F.col("step").isNotNull(), F.col("n")))
    ranks = counts.groupBy("lang").agg(F.sum("n").alias("labelled"), right.alias("right")).filter(F.col("labelled") >= calibrate_from)
    ranks = ranks.select("lang", (F.col("right") - F.floor(F.col("right") * reject_share)).alias("rank"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("cell"))
    cells = counts.filter("cell is not null").groupBy("lang", "cell").agg(F.sum("n").alias("n")).withColumn("upto", upto).join(ranks, "lang")
    cells = cells.filter("upto - n < rank and rank <= upto").select("lang", "cell", (F.col("rank") - F.col("upto") + F.col("n")).alias("left"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    return counts.join(cells, ["lang", "cell"]).withColumn("upto", upto).filter("upto >= left").groupBy("lang").agg(F.min("step").alias("limit"))


def fit_models(docs: DataFrame, id_col: str, text_col: str, lang_col: str, reject_share: float, calibrate_from: int) -> Model:
    rows = docs.filter(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    counts = rows.select(F.concat(half.cast("string"), "lang").alias("lang"), "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    whole = F.concat(F.lit("2"), F.expr("substring(lang, 2)"))  # of both halves
    fitted = model_files(counts.withColumn("lang", F.explode(F.array("lang", whole))).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    model = fitted.part("2")
    if model.langs:
        fits = None
        for mine, other in ((0, "1"), (1, "0")):
            shared = docs.sparkSession.sparkContext.broadcast(fitted.part(other))
            texts = rows.filter(half == mine).select(F.col("lang").alias("id"), F.lit(True).alias("held_out"), "text")
            judged = texts.mapInArrow(_predict(shared), "id string, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
            fits = judged if fits is None else fits.unionByName(judged)
        at = {g: i for i, g in enumerate(model.langs)}
        for g, limit in entropy_limits(fits, reject_share, calibrate_from).collect():  # a row a language, as the model has
            model.limits[at[g]] = limit
    return model


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reject_share: float = 0.005, calibrate_from: int = 200) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, cross_entropy, rejected.

    Rows whose crc32(id) mod 4 is 2 are never learned from.
    """
    model = fit_models(docs, id_col, text_col, lang_col, reject_share, calibrate_from)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), "id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("id", id_col)
