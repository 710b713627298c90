"""Secret scans: fixed rules, and two character Markov models compared by log-likelihood ratio.

Built-in functions only. The models (first order, over 64 character classes) are fitted on
labelled samples of bounded size: strings that the fixed rules find in ``sample_docs`` documents
are random strings, other words of ``word_docs`` documents, shorter than a token to judge, ordinary identifiers. Every whole text is then
scanned in one pass without a shuffle: long tokens whose mean log-likelihood ratio a
transition exceeds ``min_ratio`` (those in capitals also in small letters) are added to the spans of the fixed rules. The
default of 0 asks that a token be likelier as a random string; the tests measure it on planted strings and identifiers.

Defined results: null text is empty and has no span; without any labelled string the models
are equal and add nothing; a null id is carried along; repeated rows are scanned alike.
Positions are code points, ends exclusive. An empty table gives an empty result; very long texts
are read whole; columns other than the id, the text and those in ``keep`` are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYWORD = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_")
KINDS = {
    "assign": rf"""({_KEYWORD}?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: A run of `[0-9a-f]+` or `AKIA[A-Z0-9]+` is maximal, so these find just the matches that are long enough.
_QUICK = {"assign": KINDS["assign"], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: What the models judge: tokens of 20 characters or more (shorter ones hold too few transitions to tell).
CANDIDATE = r"[A-Za-z0-9_+/-]{20,}"
CLASSES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"
SIZE = len(CLASSES) + 1  # the last for + / -
RUN = 128
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,found:string>>"


def _matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Leftmost matches with their positions: what lies between them gives the offsets.

    Matches are taken in runs of ``RUN``, so that no array grows match by match over a whole text.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    both = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        end = at + F.length(x["found"])
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"))
        return F.when(x["found"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    def run(all_: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(all_, F.lit(1), i * RUN), F.lit(0), lambda s, x: s + x["gap"] + F.coalesce(F.length(x["found"]), F.lit(0)))
        start = F.struct(before.alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(F.slice(all_, i * RUN + 1, F.lit(RUN)), start, step, lambda acc: acc["out"])

    runs = F.transform(F.array(both), lambda all_: F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda i: run(all_, i))))
    return F.when(text.rlike(pattern), runs[0]).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed rules, by start and then kind."""
    found = []
    for rank, kind in enumerate(KINDS):
        m = _matches(text, _QUICK[kind], kind, rank)
        if kind == "assign":  # a match whose value is too short is dropped, but used up
            m = F.filter(m, lambda s: F.length(F.regexp_extract(s["found"], KINDS["assign"], 2)) >= 6)
        found.append(m)
    return F.array_sort(F.concat(*found))


def _secret(span: Column) -> Column:
    return F.when(span["kind"] == "assign", F.regexp_extract(span["found"], KINDS["assign"], 2)).otherwise(span["found"])


def _pairs(strings: Column) -> Column:
    """Transitions of all strings, as class numbers first * SIZE + second."""

    def classes(s: Column) -> Column:
        at = F.transform(F.split(s, ""), _class)
        return F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda x, y: x * SIZE + y)

    return F.flatten(F.transform(strings, classes))


def _class(c: Column) -> Column:
    n = F.call_function("instr", F.lit(CLASSES), c)
    return F.when(n == 0, SIZE - 1).otherwise(n - 1)


def log_ratios(docs: DataFrame, id_col: str, text_col: str, sample_docs: int, word_docs: int) -> list[float]:
    """log P(second | first, random) - log P(second | first, ordinary) for all pairs of classes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.col(id_col).alias("__id"), F.xxhash64(id_col).alias("__h")).filter("__id is not null").distinct()

    def sample(n: int) -> DataFrame:
        least = ids.orderBy("__h", "__id").limit(n).select("__id")
        return docs.select(F.col(id_col).alias("__id"), text.alias("text")).join(F.broadcast(least), "__id", "left_semi").select("text")  # n ids at most

    found = sample(sample_docs).select(base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    one = found.select(F.explode(_pairs(F.transform("spans", _secret))).alias("pair"), F.lit(0).alias("label"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), KINDS["assign"], " "), _QUICK["access"], " "), _QUICK["hex"], " ")
    every = F.regexp_extract_all(rest, F.lit("[A-Za-z0-9_+/-]{4,}"), F.lit(0))
    words = sample(word_docs).select(F.filter(every, lambda w: F.length(w) < 20).alias("words"))  # longer ones are what is to be judged
    two = words.select(F.explode(_pairs(F.col("words"))).alias("pair"), F.lit(1).alias("label"))
    counted = one.union(two).groupBy("label", "pair").count().collect()  # at most 2 * SIZE ** 2 rows
    count = [[0.0] * (SIZE * SIZE) for _ in range(2)]
    for label, pair, n in counted:
        count[label][pair] += n
    if {r[0] for r in counted} != {0, 1}:
        return [0.0] * (SIZE * SIZE)
    table = []
    for c in count:  # a pair's share after its first class, smoothed by the second class' own share
        single = [sum(c[j::SIZE]) + 1 for j in range(SIZE)]
        total = [sum(c[i * SIZE : (i + 1) * SIZE]) for i in range(SIZE)]
        table.append([(c[p] + 8 * single[p % SIZE] / sum(single)) / (total[p // SIZE] + 8) for p in range(SIZE * SIZE)])
    return [math.log(r) - math.log(w) for r, w in zip(*table)]


def model_spans(text: Column, base: Column, ratios: list[float], min_ratio: float) -> Column:
    """Long tokens apart from ``base`` that look more like random strings than like identifiers."""
    table = F.split(F.lit(" ".join(f"{x:.6f}" for x in ratios)), " ").cast("array<double>")  # folded to a constant
    found = _matches(text, CANDIDATE, "markov", len(KINDS))

    def mean(found: Column) -> Column:
        return F.aggregate(_pairs(F.array(found)), F.lit(0.0), lambda acc, p: acc + F.get(table, p)) / (F.length(found) - 1)

    def likely(s: Column) -> Column:  # a name is as ordinary in capitals as in small letters
        capitals = ~s["found"].rlike("[a-z]")
        return (mean(s["found"]) > min_ratio) & (~capitals | (mean(F.lower(s["found"])) > min_ratio))

    return F.filter(F.filter(found, likely), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, word_docs: int = 1_000, min_ratio: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns in ``keep``, ``base`` and ``all_spans`` (start, rank, end, kind, found)."""
    ratios = log_ratios(docs, id_col, text_col, sample_docs, word_docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(id_col, *[c for c in keep if c != id_col], text.alias("__text"), base_spans(text).alias("base"))
    added = model_spans(F.col("__text"), F.col("base"), ratios, min_ratio)
    return found.select(*[c for c in found.columns if c != "__text"], F.array_sort(F.concat("base", added)).alias("all_spans"))


def span_digests(spans: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of(kind) for kind in KINDS]
    return spans.select(id_col, *count, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("all_spans")).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each span replaced by ``mark``; overlapping spans by one mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        piece = F.when(s["start"] >= acc["at"], F.array(gap, F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    done = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
