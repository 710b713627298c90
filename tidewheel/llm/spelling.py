"""Spelling variants of a corpus' words: neighbours at one edit by a frontier on a distributed trie.

Words that differ by one edit agree on all before or on all after the middle of either. So
each word goes into the trie twice, as written and turned round, and is searched twice, from
the node of its first half on: what is left of an edit lies behind. The trie is a table of edges
by node (64-bit hash of a prefix). A node with one word below it is no node: the edge into it holds the
rest of that word. Chains of nodes with one edge are joined by pointer jumping, so a long word has as
many levels as there are branches on its way.

The search is a table of states (word, position, node, edits). Level by level it is joined with the
edges on the node: a state with no edit goes on along equal labels, or along a label that one replaced or
deleted character makes equal; a state with an edit goes on along equal labels only, and only to a node
that has words of its length and ending and an edge for what follows. A state whose rest equals the last edge is a neighbour. Inserted
characters are the deleted ones of the other word. Hashes only propose: neighbours are compared as
words, and equal hashes add edges but lose none. A node has at most an edge for each character, so a
prefix that a third of all words share grows in proportion, and Spark may split its states.

Defined results: null text has no words, a null id counts as an empty string in the hash; repeated rows
count again; one letter run of any length is one word; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Stands for a word's end when looking ahead; no word holds it.
END = "."
#: Characters of a last edge that are looked at ahead.
LOOK = 8


def variant_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """Words (word, n) of at least ``min_chars`` code points that occur ``min_count`` times; where ``every`` divides the crc32 of id and word, a character goes."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_chars},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    found = found.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = found.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _prefix(s: str, k: Column) -> Column:
    """The node of the first k characters."""
    return F.xxhash64(F.col(s).substr(F.lit(1), k))


def _both_ways(words: DataFrame) -> DataFrame:
    """Each word after a mark: as written, and turned round; ``half``: characters (the mark, too) before the search's start."""
    half = F.length("word").cast("int")
    ways = F.array(F.struct(F.concat(F.lit(">"), "word").alias("s"), (F.floor(half / 2) + 1).cast("int").alias("half")), F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("s"), (F.ceil(half / 2) + 1).cast("int").alias("half")))
    return words.select(F.inline(ways))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(n, F.lit(64)).cast("int"))


def _ending(s: Column, length: Column) -> Column:
    """One of 64 bits for a word's length and last three characters."""
    return _bit(F.xxhash64(s.substr(F.length(s) - 2, F.lit(3)), length))


def _head(rest: Column) -> Column:
    """What is kept of a last edge's label to look ahead: its first characters, or all and its end."""
    return F.concat(F.lit(","), F.concat(rest.substr(1, LOOK), F.lit(END)).substr(1, LOOK), F.lit(","))


def trie_edges(marked: DataFrame) -> DataFrame:
    """Edges (node, depth, head, label, m, s, to, child, mask, firsts, nexts, tails): the label is s[depth:to], of m characters, head its first one's code; a last edge has no child and s is its word.

    ``marked``: words s with the depth ``half`` from which on nodes are wanted. To look ahead: ``mask`` has bits for the endings of all
    words below the child, ``firsts`` for the first characters of its edges, ``nexts`` are those of its edges to nodes, ``tails`` the heads of its last edges.
    """
    at = marked.select("s", _ending(F.col("s"), F.length("s")).alias("mask"), F.explode(F.sequence("half", F.length("s"))).alias("k"))
    steps = at.select(_prefix("s", F.col("k")).alias("node"), "k", F.col("s").substr(F.col("k") + 1, F.lit(1)).alias("char"), "s", "mask")
    # a hash stands for one depth; of colliding prefixes each depth is a node of its own
    children = steps.groupBy("node", "k", "char").agg(F.count("*").alias("n"), F.min("s").alias("s"), F.bit_or("mask").alias("mask"))
    nodes = children.groupBy("node", "k").agg(F.sum("n").alias("below"), F.collect_list(F.struct("char", "n", "s", "mask")).alias("edges")).filter("below > 1")
    nexts = F.array_join(F.transform(F.filter("edges", lambda e: e["n"] > 1), lambda e: e["char"]), "")
    tails = F.array_join(F.transform(F.filter("edges", lambda e: e["n"] == 1), lambda e: _head(e["s"].substr(F.col("k") + 1, F.length(e["s"])))), "")
    firsts = F.aggregate("edges", F.lit(0).cast("long"), lambda acc, e: acc.bitwiseOR(_bit(F.ascii(e["char"]))))
    nodes = written(nodes.select("node", "k", "edges", firsts.alias("firsts"), nexts.alias("nexts"), tails.alias("tails")), "trie")
    flat = nodes.select("node", F.col("k").alias("depth"), F.inline("edges"))
    last = flat.filter("n = 1").select("node", "depth", "s", F.length("s").alias("to"), F.lit(None).cast("long").alias("child"), "mask", F.lit(None).cast("long").alias("firsts"), F.lit(None).cast("string").alias("nexts"), F.lit(None).cast("string").alias("tails"))
    inner = flat.filter("n > 1").select("node", "depth", "s", "mask", (F.col("depth") + 1).alias("to"), _prefix("s", F.col("depth") + 1).alias("child"))
    # chains: a node with one edge leads on to that edge's end
    first = F.xxhash64(F.col("edges")[0]["s"].substr(F.lit(1), F.col("k") + 1))
    chain = written(nodes.filter("size(edges) = 1").select(F.col("node").alias("child"), F.col("k").alias("to"), (F.col("k") + 1).alias("new_to"), first.alias("new_child")), "chains")
    while True:
        ahead = chain.select(F.col("child").alias("new_child"), F.col("to").alias("new_to"), F.col("new_to").alias("far"), F.col("new_child").alias("far_child"))
        longer = chain.join(ahead, ["new_child", "new_to"], "left").select("child", "to", F.coalesce("far", "new_to").alias("new_to"), F.coalesce("far_child", "new_child").alias("new_child"), F.col("far").isNotNull().alias("moved"))
        longer = written(longer, "chains")
        chain = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            break
    inner = inner.join(chain.hint("shuffle_hash"), ["child", "to"], "left").select("node", "depth", "s", F.coalesce("new_to", "to").alias("to"), F.coalesce("new_child", "child").alias("child"), "mask")
    ahead = nodes.select(F.col("node").alias("child"), F.col("k").alias("to"), "firsts", "nexts", "tails")
    edges = inner.join(ahead.hint("shuffle_hash"), ["child", "to"]).select(*last.columns).unionByName(last)
    m = F.col("to") - F.col("depth")
    edges = edges.withColumns({"m": m, "label": F.col("s").substr(F.col("depth") + 1, m)}).withColumn("head", F.ascii("label"))
    return written(edges, "edges")


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states (s, at, node, depth, edits) after one level, and found words (s, found)."""
    s, at = F.col("s"), F.col("at")
    code = lambda k: F.ascii(s.substr(at + k, F.lit(1)))
    ends = _ending(s, F.length("s")).bitwiseOR(_ending(s, F.length("s") - 1))  # a found word is as long or shorter by one
    states = states.select("s", "at", "node", "depth", "edits", F.length("s").alias("size"), code(1).alias("next"), code(2).alias("second"), _bit(code(2)).alias("then"), ends.alias("ends"))
    e = edges.withColumnsRenamed({"node": "from", "depth": "from_depth", "s": "other"})
    m, label, clean, is_last = F.col("m"), F.col("label"), F.col("edits") == 0, F.col("child").isNull()
    ends_alike = F.col("mask").bitwiseAND(F.col("ends")) != 0
    left = F.col("size") - at
    # numbers only, for each pair of a state and an edge: an edit at the edge's first character leaves endings alike, and one that is all of a label is followed by an edge
    at_first = F.when(is_last, (left - m).isin(0, 1) & ((m < 4) | ends_alike)).otherwise(((left < 5) | ends_alike) & ((m > 1) | (F.col("firsts").bitwiseAND(F.col("then")) != 0) | (F.col("head") == F.col("second"))))
    meets = (F.col("node") == F.col("from")) & (F.col("depth") == F.col("from_depth")) & ((F.col("head") == F.col("next")) | (clean & at_first))

    same, more, rest = s.substr(at + 1, m), s.substr(at + 1, m + 1), s.substr(at + 1, F.col("size"))
    kind = "struct<found:string,at:int,node:bigint,depth:int,edits:int>"

    def go(when: Column, used: Column, edits: Column) -> Column:
        now = at + used
        after = s.substr(now + 1, F.lit(LOOK))
        follows = (F.contains("nexts", after.substr(1, 1)) & (after != "")) | F.contains("tails", _head(after))
        return F.when(when & ((edits == 0) | (((F.col("size") - now < 3) | ends_alike) & follows)), F.struct(F.lit(None).cast("string").alias("found"), now.alias("at"), F.col("child").alias("node"), F.col("to").alias("depth"), edits.cast("int").alias("edits")).cast(kind))

    # a deleted character before an equal label's end is the next level's, where it comes first
    replaced = clean & (label != same) & (F.length(same) == m) & ((m == 1) | (F.levenshtein(same, label, 1) == 1))
    deleted = clean & (label != same) & (F.length(more) == m + 1) & F.when(m == 1, F.col("head") == F.col("second")).otherwise(F.levenshtein(more, label, 1) == 1)
    hit = F.when(clean, (left - m).isin(0, 1) & (F.levenshtein(rest, label, 1) == 1)).otherwise(rest == label)
    found = F.when(hit, F.struct(F.col("other").alias("found"), *[F.lit(None).cast(t).alias(c) for c, t in (("at", "int"), ("node", "long"), ("depth", "int"), ("edits", "int"))]).cast(kind))
    onward = F.when(is_last, F.array(found)).otherwise(F.array(go(label == same, m, F.col("edits")), go(replaced, m, F.lit(1)), go(deleted, m + 1, F.lit(1))))
    # a node has few edges, so a hash table of edges by node is even, and neither side is sorted
    return states.join(e.hint("shuffle_hash"), meets).select("s", F.inline(F.array_compact(onward)))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, near), both ways round, of words that differ by one inserted, deleted or replaced code point."""
    marked = written(_both_ways(words), "marked")
    edges = trie_edges(marked)
    states = marked.select("s", F.col("half").alias("at"), _prefix("s", F.col("half")).alias("node"), F.col("half").alias("depth"), F.lit(0).alias("edits"))
    found = []
    while True:
        level = written(_step(states, edges), "frontier")
        found.append(level.filter("found is not null").select("s", "found"))
        states = level.filter("node is not null").select("s", "at", "node", "depth", "edits")
        if states.isEmpty():
            break

    def plain(c: str) -> Column:
        w = F.col(c).substr(F.lit(2), F.length(c))
        return F.when(F.col(c).startswith("<"), F.reverse(w)).otherwise(w)

    pairs = reduce(DataFrame.unionAll, found).select(plain("s").alias("word"), plain("found").alias("near")).filter(F.levenshtein("word", "near", 1) == 1)
    return pairs.unionAll(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def group_variants(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """Words (word, n) -> word, n, n_near, form, form_n, root.

    A word's form is its most frequent near word (ties: the least by code points) if that is at least ``ratio`` times as frequent;
    its root is where following forms ends. Each form is ``ratio`` times as frequent, so there is no circle and a way has few steps.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    counted = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best"))
    has = F.col("best.near_n") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("best.near_n")).alias("form_n"))
    rows = written(rows, "forms")
    step = rows.filter("form is not null").select(F.col("word").alias("root"), F.col("form").alias("next"))
    way = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        way = written(way.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if way.filter("moved").isEmpty():
            break
        way = way.drop("moved")
    return rows.join(way.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
