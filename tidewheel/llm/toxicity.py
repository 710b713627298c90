"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels.

A sentence's score is a logistic function of its known words; a document's is
1 - (1 - base) * product(1 - sentence score), so one bad sentence is enough. Sentences
without a known word add nothing, which keeps long clean texts low.

Fitting is on a bounded sample of labelled rows: at most ``sample_docs`` documents of at most
``sample_chars`` characters (parameters), by a hash of the id; words of the model are the
``max_words`` with the most telling document counts, of those in ``min_docs`` documents or more whose
count of toxic ones is ``min_telling`` standard deviations or more from the share of all (other words
would take over the weight in small samples). Scoring covers every whole text, without a
shuffle; the model (16 bytes a word) is broadcast.

Defined results: null or empty text gets the base score; without labelled rows every score
is 0, without a telling word it is the base score; several labels of a document count as the
largest; null labels are left out; repeated rows are scored alike. An empty table gives an empty result; very long texts are scored whole (and are
not fitted on); columns other than id, text and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, slices, split_words

#: Bytes between words: all ASCII but letters and digits.
_BETWEEN = np.ones(256, bool)
_BETWEEN[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _BETWEEN[_a:_b] = False
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def _sentences(w: Words) -> np.ndarray:
    """Number of each word's sentence over the slice."""
    ends = np.concatenate([[0], np.cumsum(_END[w.data])])
    new = np.ones(len(w.hash), bool)
    new[1:] = (ends[w.start[1:]] != ends[w.start[:-1]]) | (w.doc[1:] != w.doc[:-1])
    return np.cumsum(new) - 1


PREFIXES = (6, 7, 8)
MIN_TELLING = 2.5


def _units(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The model's features: words and the first bytes of longer words, as (word index, hash)."""
    parts = [(np.arange(len(w.hash)), w.hash)] + [w.prefixes(n) for n in PREFIXES if len(w.hash)]
    at, h = (np.concatenate(x) for x in zip(*parts))
    return at, h.view(np.int64)


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in slices(batch, "text"):
            w = split_words(data, off, fold=True, space=_BETWEEN)
            label = part.column("label").to_numpy(zero_copy_only=False)
            own, h = _units(w)
            doc = w.doc[own]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            word, at = np.unique(h[new], return_inverse=True)
            n = np.bincount(at, minlength=len(word))
            bad = np.bincount(at, weights=label[doc[new]], minlength=len(word)).astype(np.int64)
            yield pa.record_batch([pa.array(word), pa.array(n.astype(np.int64)), pa.array(bad)], ["word", "n", "bad"])


def _known(words: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Units that the model has, as (word index, number in the model)."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, h = _units(w)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = np.flatnonzero(words[at] == h)
    return own[hit], at[hit]


def _instances(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                w = split_words(data, off, fold=True, space=_BETWEEN)
                sent = _sentences(w)
                own, known = _known(words, w)
                cells = np.unique(np.column_stack([w.doc[own], sent[own], known]), axis=0)
                cut = np.searchsorted(cells[:, 0], np.arange(part.num_rows + 1))
                local = [cells[a:b] for a, b in zip(cut[:-1], cut[1:])]
                yield pa.record_batch([part.column("label"), pa.array([x[:, 1].tolist() for x in local], pa.list_(pa.int64())), pa.array([x[:, 2].tolist() for x in local], pa.list_(pa.int64()))], ["label", "sentence", "word"])

    return run


def fit_noisy_or(label: np.ndarray, doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, n_words: int, rounds: int = 300, rate: float = 0.1, penalty: float = 0.002) -> tuple[np.ndarray, float, float]:
    """Weights, bias and base probability by gradient descent on the documents' likelihood.

    One entry per known word of a sentence: its document, sentence (0, 1, ... over all) and word.
    """
    n_sent = int(sentence.max()) + 1 if len(sentence) else 0
    owner = np.zeros(n_sent, np.int64)
    owner[sentence] = doc
    theta = np.zeros(n_words + 2)
    theta[n_words], theta[n_words + 1] = -2.0, -3.0  # bias of a sentence, logit of the base
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, weights=theta[word], minlength=n_sent) + theta[n_words]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        base = 1 / (1 + np.exp(-theta[n_words + 1]))
        log_clean = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(label)) + np.log1p(-base)
        clean = np.exp(log_clean)
        # d loss / d log_clean: toxic rows lose by being clean, the others gain
        g = np.where(label == 1, clean / np.maximum(1 - clean, 1e-6), -1.0) / len(label)
        gz = -g[owner] * p  # d log(1 - p) / dz = -p
        grad = np.concatenate([np.bincount(word, weights=gz[sentence], minlength=n_words), [gz.sum(), -(g * base).sum()]])
        grad[:n_words] += penalty * theta[:n_words] / max(1, n_words) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:n_words], float(theta[n_words]), float(1 / (1 + np.exp(-theta[n_words + 1])))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int, sample_chars: int, max_words: int, min_docs: int, min_telling: float = MIN_TELLING) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Word hashes (sorted), weights, bias and base probability."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    marked = marked.filter(F.crc32(F.col("id").cast("string")) % 3 != 1).groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    short = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") <= sample_chars)
    ids = short.select("id").join(marked, "id").groupBy("id").agg(F.first("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    sample = short.join(F.broadcast(ids), "id").select("label", "text")  # sample_docs rows of 12 bytes
    sample = sample.persist()
    counts = sample.mapInArrow(_document_words, "word long, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    totals = sample.agg(F.count("*"), F.sum("label")).first()
    n_docs, n_bad = int(totals[0]), int(totals[1] or 0)
    if not n_docs:
        sample.unpersist()
        return np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0
    share = n_bad / n_docs
    telling = F.abs(F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-9)))
    top = counts.filter(F.col("n") >= min_docs).filter(telling >= min_telling).orderBy(telling.desc(), "word").limit(max_words).select("word").collect()
    words = np.sort(np.array([r[0] for r in top], np.int64))
    rows = sample.mapInArrow(_instances(words), "label int, sentence array<long>, word array<long>").toArrow()
    sample.unpersist()
    label = rows.column("label").to_numpy()
    size = np.concatenate([c.value_lengths().to_numpy() for c in rows.column("sentence").chunks] or [np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(len(label)), size)
    sent, word = (np.concatenate([c.flatten().to_numpy() for c in rows.column(x).chunks] or [np.zeros(0, np.int64)]) for x in ("sentence", "word"))
    _, sent = np.unique(np.column_stack([doc, sent]), axis=0, return_inverse=True)
    weights, bias, base = fit_noisy_or(label, doc, sent.ravel(), word, len(words))
    return words, weights, bias, base


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, bias, base = shared.value
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                w = split_words(data, off, fold=True, space=_BETWEEN)
                n = part.num_rows
                own, at = _known(words, w)
                log_clean = np.full(n, np.log1p(-base))
                found: list[list] = [[] for _ in range(n)]
                if len(own):
                    sent = _sentences(w)
                    cell = np.unique(sent[own] * len(words) + at)  # a word counts once in a sentence
                    s, word = cell // len(words), cell % len(words)
                    some, inv = np.unique(s, return_inverse=True)
                    p = 1 / (1 + np.exp(-np.clip(np.bincount(inv, weights=weights[word]) + bias, -30, 30)))
                    first = np.searchsorted(sent, some)
                    last = np.searchsorted(sent, some, "right") - 1
                    owner = w.doc[first]
                    log_clean += np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
                    for i in np.flatnonzero(p >= 0.5).tolist():
                        d, a, b = owner[i], w.start[first[i]], w.end[last[i]]
                        chars = lambda x, y: int(((data[x:y] & 0xC0) != 0x80).sum())
                        start = chars(off[d], a)
                        found[d].append({"start": start, "end": start + chars(a, b), "score": float(p[i])})
                score = 1 - np.exp(log_clean)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.record_batch([part.column("id"), pa.array(score), pa.array(found, span)], ["id", "score", "sentences"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 8000, sample_chars: int = 20_000, max_words: int = 4096, min_docs: int = 3, min_telling: float = MIN_TELLING, threshold: float = 0.7) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, and the sentences that score 0.5 or more (code points, end exclusive).

    Labels of documents whose crc32(id) mod 3 is 1 are never read.
    """
    model = fit(docs, labels, id_col, text_col, label_col, sample_docs, sample_chars, max_words, min_docs, min_telling)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    done = rows.mapInArrow(_score(shared), "id long, score double, sentences array<struct<start:long,end:long,score:double>>")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return done.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")
