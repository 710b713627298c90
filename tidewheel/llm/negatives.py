"""Hard negatives of anchors by exact inner products, pruned along spanning trees of anchors.

Vectors become integers, so scores are exact and ties have an order. Rows are packed into chunks, anchors
(the stated query set) into blocks of near ones: sorted by label and the signs of fixed random
projections, each block with the minimum spanning tree of its anchors. Within a block and a chunk
the root is scored in full. A child's score of a row lies within (edge length) x (row's norm) of its parent's
score or bounds, so only rows whose interval overlaps what the child still looks for are scored
again: for positives, scores from the k-th best so far up; for negatives, the windows under its
positives, cut at the k-th best so far in each.

Blocks are read in passes of at most ``pass_bytes``; a pass is broadcast and meets all chunks,
each task keeping the best of each anchor over all its chunks; then the tasks' best are merged by
anchor. So no rows of two tables are paired in a shuffle, and a label or a vector that a third of the
rows share only means more rows in chunks. Work grows with anchors times rows, pruned by the trees;
memory does not: a block and a chunk, and some rows an anchor of the pass.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a
null id comes last among ties and is no anchor unless ``anchor`` says so; repeated rows and ids are
rows of their own (an anchor's other rows are all but itself); components beyond +-2^22 after scaling count as
that; of vectors of unequal lengths the missing components count as 0, so an empty vector scores 0. An
empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_last, null_back, written

LIMIT = 1 << 22
CHUNK = "chunk long, n int, n_anchors int, anchor_bytes long, ids binary, labels binary, anchors binary, vectors binary"
ANCHOR = "chunk long, row int, id long, label long, code long, v binary"
BLOCK = "pass long, block long, chunks binary, rows binary, ids binary, labels binary, parents binary, edges binary, vectors binary"
BEST = "block long, a int, anchor_id long, id long, score long, chunk long, row int"
_NONE = np.iinfo(np.int64).min


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles, short ones filled with 0, and which rows hold finite numbers only."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    end = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok = bad[end] == bad[end - size]
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(x)) - np.repeat(end - size, size)] = x
    return out[ok], ok


def _chunks(scale: float, rows: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column("label").is_valid(), batch.column("v").is_valid()))
            x, ok = _matrix(batch.column("v"))
            q = np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype("<i4")
            ids, labels, anchor = (batch.column(c).to_numpy(zero_copy_only=False)[ok] for c in ("id", "label", "anchor"))
            step = max(1, min(rows, limit // max(4, 4 * q.shape[1])))
            for at in range(0, len(q), step):
                order = at + np.argsort(ids[at : at + step], kind="stable")
                n = int(np.count_nonzero(anchor[order]))
                cols = [[number], [len(order)], [n], [n * 4 * q.shape[1]], [ids[order].astype("<i8").tobytes()], [labels[order].astype("<i8").tobytes()], [anchor[order].astype("u1").tobytes()], [q[order].tobytes()]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in CHUNK.split(", ")])
                number += 1

    return run


def _open(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk: its number, ids, labels, anchor marks and integer vectors."""
    n = batch.column("n")[i].as_py()
    ids, labels, anchors, v = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in (("ids", "<i8"), ("labels", "<i8"), ("anchors", "u1"), ("vectors", "<i4")))
    return batch.column("chunk")[i].as_py(), ids, labels, anchors.astype(bool), v.reshape(n, -1)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            chunk, ids, labels, anchors, v = _open(batch, i)
            at = np.flatnonzero(anchors)
            planes = np.random.default_rng(7).standard_normal((v.shape[1], 24))
            code = ((v[at] @ planes > 0) @ (1 << np.arange(24))[::-1]).astype(np.int64)
            cols = [pa.array(np.full(len(at), chunk)), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array(labels[at]), pa.array(code), pa.array([r.tobytes() for r in v[at]], pa.binary())]
            yield pa.record_batch(cols, [c.split()[0] for c in ANCHOR.split(", ")])


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which parents come first, and each one's parent as a place in that order (-1: the root)."""
    n, x = len(v), v.astype(np.float64)
    square = (x * x).sum(axis=1)
    order, parent = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    nearest, by, done = np.full(n, np.inf), np.full(n, -1, np.int64), np.zeros(n, bool)
    at = 0
    for k in range(n):
        order[k], parent[k], done[at] = at, by[at], True
        d = square + square[at] - 2 * (x @ x[at])
        closer = ~done & (d < nearest)
        nearest[closer], by[closer] = d[closer], k
        at = int(np.argmin(np.where(done, np.inf, nearest)))
    return order, parent


def _blocks(most: int, limit: int, pass_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        waiting: list[dict] = []
        held, sent, number = 0, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal held, sent, number
            vectors = [np.frombuffer(r["v"], "<i4") for r in waiting]
            v = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
            for k, x in enumerate(vectors):
                v[k, : len(x)] = x
            order, parent = spanning_tree(v)
            v = v[order]
            edges = np.where(parent >= 0, np.sqrt(((v - v[parent]).astype(np.float64) ** 2).sum(axis=1)), 0.0)
            pick = lambda c, k: np.array([waiting[i][c] for i in order], k).tobytes()
            size = v.size * 4 + 48 * len(v)
            sent += size
            row = [(task << 32) + (sent - size) // pass_bytes, (task << 32) + number, pick("chunk", "<i8"), pick("row", "<i4"), pick("id", "<i8"), pick("label", "<i8"), parent.astype("<i4").tobytes(), edges.astype("<f8").tobytes(), v.astype("<i4").tobytes()]
            number += 1
            held = 0
            waiting.clear()
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, [pa.int64()] * 2 + [pa.binary()] * 7)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                waiting.append(r)
                held += len(r["v"]) + 48
                if len(waiting) >= most or held >= limit:
                    yield out()
        if waiting:
            yield out()

    return run


class _Block:
    def __init__(self, row):
        read = lambda c, k: np.frombuffer(row[c], k)
        self.block, self.chunks, self.rows, self.ids, self.labels = row["block"], read("chunks", "<i8"), read("rows", "<i4"), read("ids", "<i8"), read("labels", "<i8")
        self.parents, self.edges = read("parents", "<i4"), read("edges", "<f8")
        self.v = read("vectors", "<i4").reshape(len(self.ids), -1)
        self.norm = float(np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        found = row.asDict().get("windows")
        #: For each anchor: (rank of a positive, least and greatest score of its window).
        self.windows: list[list[tuple[int, int, int]]] = [[] for _ in self.ids]
        for w in found or ():
            self.windows[w["a"]].append((w["j"], w["low"], w["high"]))


class _Best:
    """The first k rows of a list by falling score, then id, chunk and row."""

    def __init__(self, k: int):
        self.k = k
        self.rows = np.zeros((4, 0), np.int64)  # -score, id, chunk, row
        self.floor = _NONE

    def put(self, score: np.ndarray, ids: np.ndarray, chunk: int, rows: np.ndarray) -> None:
        if len(score) > 4 * self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            on = score >= least
            score, ids, rows = score[on], ids[on], rows[on]
        new = np.stack([-score, ids, np.full(len(score), chunk, np.int64), rows])
        both = np.concatenate([self.rows, new], axis=1)
        self.rows = both[:, np.lexsort(both[::-1])[: self.k]]
        if self.rows.shape[1] == self.k:
            self.floor = -int(self.rows[0, -1])


def _walk(block: _Block, v: np.ndarray, wanted, found) -> int:
    """Scores rows along the block's tree: ``wanted(a, low, high)`` marks the rows to score for anchor a, ``found(a, rows, scores)`` takes them; returns how many were scored."""
    dims = min(v.shape[1], block.v.shape[1])
    x = v.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    exact = block.norm * float(norm.max(initial=0)) < 2**53
    slack = 1 + 1e-12 * block.norm * float(norm.max(initial=0))
    x, w = (x[:, :dims], block.v[:, :dims].astype(np.float64)) if exact else (v[:, :dims].astype(np.int64), block.v[:, :dims].astype(np.int64))
    low, high = np.empty((len(block.ids), len(v))), np.empty((len(block.ids), len(v)))
    scored = 0
    for a, (parent, edge) in enumerate(zip(block.parents.tolist(), block.edges.tolist())):
        if parent < 0:
            score = (x @ w[a]).astype(np.int64)
            low[a] = high[a] = score
            scored += len(score)
            on = np.flatnonzero(wanted(a, low[a], high[a]))
            found(a, on, score[on])
            continue
        reach = norm * (edge * (1 + 1e-9)) + slack if edge else 0.0
        np.subtract(low[parent], reach, out=low[a])
        np.add(high[parent], reach, out=high[a])
        on = np.flatnonzero(wanted(a, low[a], high[a]))
        if len(on):
            score = (x[on] @ w[a]).astype(np.int64)
            low[a, on] = high[a, on] = score
            scored += len(on)
            found(a, on, score)
    return scored


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _positives(blocks, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [_Block(r) for r in blocks.value]
        best = [[_Best(k) for _ in b.ids] for b in opened]
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, ids, labels, _, v = _open(batch, i)
                for b, top in zip(opened, best):
                    mine = np.flatnonzero(np.isin(labels, np.unique(b.labels)))
                    if not len(mine):
                        continue
                    own = labels[mine]

                    def wanted(a, low, high, b=b, top=top, own=own):
                        return (own == b.labels[a]) & (high >= top[a].floor)

                    def found(a, on, score, b=b, top=top, mine=mine):
                        rows = mine[on]
                        if b.chunks[a] == chunk:
                            other = rows != b.rows[a]
                            rows, score = rows[other], score[other]
                        if len(rows):
                            top[a].put(score, ids[rows], chunk, rows)

                    _walk(b, v[mine], wanted, found)
        names, kinds = [c.split()[0] for c in BEST.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for b, top in zip(opened, best):
            rows = [(b.block, a, int(b.ids[a]), i, -s, c, r) for a, t in enumerate(top) for s, i, c, r in t.rows.T.tolist()]
            if rows:
                yield _batch(rows, names, kinds)

    return run


def _negatives(blocks, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [_Block(r) for r in blocks.value]
        best = [[[(_Best(k), low, high) for _, low, high in w] for w in b.windows] for b in opened]
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, ids, labels, _, v = _open(batch, i)
                for b, top in zip(opened, best):

                    def wanted(a, low, high, b=b, top=top):
                        on = np.zeros(len(low), bool)
                        for t, least, most in top[a]:
                            on |= (high >= max(least, t.floor)) & (low <= most)
                        return on & (labels != b.labels[a])

                    def found(a, on, score, top=top):
                        for t, least, most in top[a]:
                            fits = (score >= max(least, t.floor)) & (score <= most)
                            if fits.any():
                                t.put(score[fits], ids[on[fits]], chunk, on[fits])

                    _walk(b, v, wanted, found)
        names = [*(c.split()[0] for c in BEST.split(", ")), "js"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
        for b, top in zip(opened, best):
            rows = []
            for a, windows in enumerate(top):
                of: dict[tuple, list[int]] = {}
                for (t, *_), (j, *_) in zip(windows, b.windows[a]):
                    for row in map(tuple, t.rows.T.tolist()):
                        of.setdefault(row, []).append(j)
                rows += [(b.block, a, int(b.ids[a]), i, -s, c, r, js) for (s, i, c, r), js in of.items()]
            if rows:
                yield _batch(rows, names, kinds)

    return run


def _first(df: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    """The first k rows of each group by falling score, then id (and place)."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "chunk", "row")
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def mine_hard_negatives(vectors: DataFrame, *, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, of: int = 10, chunk_rows: int = 4096, block_anchors: int = 512, pass_bytes: int = 1 << 26) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` marks the anchors among the rows, ``label`` is the rows' label (column ``label`` otherwise).
    Of each anchor and each of its ``positives`` best other rows of its label, the ``negatives`` best rows of other labels
    with low * positive_score <= of * score <= high * positive_score.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(id_or_last(id_col).alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias("v"))
    chunks = written(rows.mapInArrow(_chunks(scale, chunk_rows, 1 << 22), CHUNK), "chunks")
    total = chunks.agg(F.sum("anchor_bytes"), F.sum("n_anchors")).first()
    tasks = max(1, -(-((total[0] or 0) + 48 * (total[1] or 0)) // pass_bytes))
    ordered = ["label", "code", "chunk", "row"]
    found = chunks.filter("n_anchors > 0").mapInArrow(_anchors, ANCHOR).repartitionByRange(*ordered).coalesce(tasks).sortWithinPartitions(*ordered)
    blocks = written(found.mapInArrow(_blocks(block_anchors, 1 << 20, pass_bytes), BLOCK), "blocks")
    passes = sorted(r[0] for r in blocks.select("pass").distinct().collect())
    done = [_one_pass(chunks, blocks.filter(F.col("pass") == p), positives, negatives, low, high, of) for p in passes]
    if not done:
        none = chunks.select(*[F.lit(None).cast("long").alias(c) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]).filter("false")
        return none.withColumn("rank", F.col("rank").cast("int"))
    return reduce(DataFrame.unionAll, done)


def _one_pass(chunks: DataFrame, blocks: DataFrame, positives: int, negatives: int, low: int, high: int, of: int) -> DataFrame:
    """Results of the anchors of some blocks, which fit a broadcast."""
    sc = chunks.sparkSession.sparkContext
    held = sc.broadcast(blocks.collect())
    best = _first(chunks.mapInArrow(_positives(held, positives), BEST), ["block", "a"], positives, "j")
    best = written(best.select("block", "a", "anchor_id", "j", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    held.unpersist()
    # whole-number bounds of a window: low * positive <= of * score <= high * positive
    down = lambda x: f"({x} - pmod({x}, {of}L)) div {of}L"
    window = F.struct("a", "j", F.expr(f"-({down(f'({-low}L * positive_score)')})").alias("low"), F.expr(down(f"({high}L * positive_score)")).alias("high"))
    held = sc.broadcast(blocks.join(best.groupBy("block").agg(F.collect_list(window).alias("windows")), "block").collect())
    near = chunks.mapInArrow(_negatives(held, negatives), BEST + ", js array<int>").repartition("block", "a").withColumn("j", F.explode("js"))
    worst = _first(near, ["block", "a", "j"], negatives, "rank").select("block", "a", "j", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    done = worst.join(best, ["block", "a", "j"]).select(*[null_back(c).alias(c) for c in ("anchor_id", "positive_id")], "rank", null_back("negative_id").alias("negative_id"), "positive_score", "negative_score")
    done = written(done, "negatives")
    held.unpersist()
    return done
