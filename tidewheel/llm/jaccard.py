"""Exact Jaccard self-join of word-shingle sets by parity sketches.

A set's sketch has K blocks; each token XORs its 64-bit hash into the block its hash picks.
Blocks that differ prove a token of the symmetric difference, so their number is a lower
bound of its size. A pair with Jaccard >= 0.8 has a symmetric difference of at most
(a + b) / 9; the band of the smaller set fixes d, the largest such value in the band, and
K = d + 1 + slack. By the pigeonhole principle such a pair agrees in K - d blocks at least,
and so meets in a join on (band, block, parity).

The slack makes hot parities harmless without loss: a set whose own pairs differ in at most
e tokens shares K - e blocks with each partner, and may drop its K - e - 1 most frequent ones
(empty blocks first) in one global order, since the rarest shared block is never among them.

A key that many classes of one task share is sent by (key, class), with one marker to the
key's own place, so no key comes together in one task.

Groups of equal parities are joined in two steps, neither of which makes all pairs:
first every member meets the group's least class and its most central one (whose own groups
are the largest); then, in groups that still hold several components, the members outside the
group's largest component meet all members in blocks of bounded bytes. There, parity bits
of a number that the band's bound asks for tell which members have a near one in another
component; only these meet again with their sets, and a block gives no more links than it
joins components. Both steps verify on the exact shingle sets.

Copies (equal sets) are one class throughout. Defined results: null or wordless text has
an empty set and links with nothing; under five words the whole sequence is one shingle; a
null id comes last and its component is null where no other document is in it. Ties and
repeated rows are copies; an empty table gives an empty result; a very long text is one row
of a slice, its set in one block row. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_or_last, null_back, written
from .words import flat, grams, mix, slices, split_words

SHINGLE = 5
BITS = 512
BLOCK_ROWS = 8192
BLOCK_BYTES = 32 << 20
FLUSH = 500_000
MANY = 16
RATIO = 1.6
_U = np.uint64


def _bands() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 32:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
    return np.array(edges, np.int64)


EDGES = _bands()
_TOP = EDGES[1:] - 1
#: The largest symmetric difference of a linked pair whose smaller set is in band i.
D = (_TOP + _TOP * 5 // 4) // 9
K = D + 1 + (D > 0) + D // 16


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and their bounds."""
    w = split_words(data, off, fold=True)
    pos, h = grams(w, SHINGLE)
    doc = w.doc[pos]
    few = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if len(few):
        extra = []
        for d in few:
            v = w.counts[d : d + 1].astype(_U)
            for y in w.hash[w.first[d] : w.first[d + 1]]:
                v = mix(v * _U(0x9E3779B97F4A7C15) + y)
            extra.append(v[0])
        doc, h = np.concatenate([doc, few]), np.concatenate([h, np.array(extra, _U)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(off)))


def _per_doc(f, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """f.reduceat over each document's part; 0 for an empty one."""
    out = np.zeros(len(at) - 1, x.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = f.reduceat(x, at[full])
    return out


def classes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 63-bit id of each document's set."""
    return (mix(_per_doc(np.add, mix(h ^ _U(0x2545F4914F6CDD1D)), at) + np.diff(at).astype(_U)) >> _U(1)).astype(np.int64)


def parities(h: np.ndarray, at: np.ndarray, n: np.ndarray, docs: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents ``docs`` joined in ``band``: (document, key) of non-empty blocks, and how many frequent blocks each may still drop."""
    k = K[band]
    size = n[docs]
    start = np.repeat(at[docs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    x = h[start + np.arange(size.sum())]
    row = np.repeat(np.arange(len(docs)), size)
    block = ((x >> _U(32)) * k[row].astype(_U) >> _U(32)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(k)[:-1]])
    cell = first[row] + block  # ascending: hashes are sorted within a document
    cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    parity = np.bitwise_xor.reduceat(mix(x ^ _U(0x632BE59BD9B4E019)), cut)
    r, b = row[cut], block[cut]
    key = mix(parity + mix((band[r] * (1 << 40) + b).astype(_U)))
    key = (key & ~_U(63)) | band[r].astype(_U)
    full = np.bincount(r, minlength=len(docs))
    spare = k - np.minimum((size + size * 5 // 4) // 9, D[band]) - 1 - (k - full)
    missing = np.flatnonzero(spare < 0)
    if len(missing):  # too many empty blocks: they count as agreeing, too
        have = np.zeros(int(k.sum()), bool)
        have[cell] = True
        need = np.isin(np.repeat(np.arange(len(docs)), k), missing) & ~have
        cell = np.flatnonzero(need)
        rr = np.repeat(np.arange(len(docs)), k)[cell]
        kk = mix(mix((band[rr] * (1 << 40) + cell - first[rr]).astype(_U)))
        r, key = np.concatenate([r, rr]), np.concatenate([key, (kk & ~_U(63)) | band[rr].astype(_U)])
    return docs[r], key.view(np.int64), np.maximum(spare, 0)


def _joined_bands(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, band): each set in its own band, and as the larger partner in the band below."""
    docs = np.flatnonzero(n > 0)
    own = np.searchsorted(EDGES, n[docs], "right") - 1
    yield docs, own
    below = (own > 0) & (n[docs] <= _TOP[np.maximum(own - 1, 0)] * 5 // 4)
    yield docs[below], own[below] - 1


SETS = "doc long, th long, cls long, n long, own int, spare0 int, spare1 int, " + ", ".join(f"s{i} long" for i in range(BITS // 64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in slices(batch, "text"):
            h, at = shingle_sets(data, off)
            n = np.diff(at)
            cls = classes(h, at)
            bit = (mix(h ^ _U(0x1B873593CC9E2D51)) >> _U(64 - 9)).astype(np.int64)
            cell = np.repeat(np.arange(len(n)), n) * BITS + bit
            bits = (np.bincount(cell, minlength=len(n) * BITS) & 1).astype(np.uint8).reshape(len(n), BITS)
            words = np.packbits(bits, axis=1).view(np.int64)
            spare = np.zeros((2, len(n)), np.int32)
            own = np.zeros(len(n), np.int32)
            for i, (docs, band) in enumerate(_joined_bands(n)):
                if len(docs):
                    spare[i, docs] = parities(h, at, n, docs, band)[2]
                if i == 0:
                    own[docs] = band
            cols = [part.column("doc"), part.column("th"), pa.array(cls, mask=n == 0), pa.array(n), pa.array(own), pa.array(spare[0]), pa.array(spare[1])] + [pa.array(words[:, i]) for i in range(BITS // 64)]
            yield pa.record_batch(cols, [x.split()[0] for x in SETS.split(", ")])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, class) of each class once a flush. ``many``: a key of at least ``MANY`` classes here, whose rows
    are dealt by class, too; one row with a null class then tells the key's own place that it is shared."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[int] = set()

    def out() -> pa.RecordBatch:
        key, cls = (np.concatenate(x) for x in zip(*held))
        held.clear()
        seen.clear()
        u, inv, n = np.unique(key, return_inverse=True, return_counts=True)
        hot = u[n >= MANY]
        many = np.concatenate([n[inv] >= MANY, np.zeros(len(hot), bool)])
        mark = np.concatenate([np.zeros(len(key), bool), np.ones(len(hot), bool)])
        key = np.concatenate([key, hot])
        return pa.record_batch([pa.array(key), pa.array(np.concatenate([cls, hot]), mask=mark), pa.array(many)], ["key", "cls", "many"])

    for batch in batches:
        for _, data, off in slices(batch, "text"):
            h, at = shingle_sets(data, off)
            n = np.diff(at)
            cls = classes(h, at)
            fresh = np.ones(len(n), bool)
            for i, c in enumerate(cls.tolist()):
                fresh[i] = c not in seen
                seen.add(c)
            for docs, band in _joined_bands(np.where(fresh, n, 0)):
                if len(docs):
                    d, key, _ = parities(h, at, n, docs, band)
                    held.append((key, cls[d]))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield out()
    if held:
        yield out()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that two classes or more share; rows come sorted by key and only the last key's are held."""

    def out(key: np.ndarray, cls: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(cut, len(key)))
        two = (np.maximum.reduceat(cls, cut) != np.minimum.reduceat(cls, cut)) | np.logical_or.reduceat(sure, cut)
        keep = np.repeat(two, size) & (cls >= 0)
        return pa.record_batch([pa.array(key[keep]), pa.array(cls[keep])], ["key", "cls"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    for b in batches:
        marker = b.column("cls").is_null().to_numpy(zero_copy_only=False)
        rows = [b.column("key").to_numpy(), b.column("cls").fill_null(-1).to_numpy(), marker | b.column("many").to_numpy(zero_copy_only=False)]
        rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
        key = rows[0]
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield out(*[x[:last] for x in rows])
        held = [x[last:] for x in rows]
        if len(held[0]) > FLUSH and (held[2].any() or held[1].min() != held[1].max()):  # surely shared: the rest may come later
            yield out(*held)
            held = [held[0][:1], np.full(1, -1), np.ones(1, bool)]
    if len(held[0]):
        yield out(*held)


#: Parity bits that tell members of band i apart beyond its bound.
BAND_BITS = np.array([1 << int(max(BITS, 12 * d) - 1).bit_length() for d in D.tolist()])


def _sketch(h: np.ndarray, bits: int) -> bytes:
    cell = (mix(h ^ _U(0x1B873593CC9E2D51)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """Sketches of ``words`` 64-bit words: longer ones are folded, as their bits are chosen by low hash bits."""
    if len({len(x) for x in sketches}) == 1:
        return np.stack(sketches)
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in sketches])


def _exact_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in slices(batch, "text"):
            h, at = shingle_sets(data, off)
            cls, own = part.column("cls").to_numpy(), part.column("own").to_numpy()
            same = pa.array(classes(h, at) == cls)
            sets = [h[a:b] for a, b in zip(at[:-1], at[1:])]
            cols = [part.column("cls"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([_sketch(x, BAND_BITS[o]) for x, o in zip(sets, own)], pa.binary())]
            yield pa.record_batch(cols, ["cls", "tokens", "sketch"]).filter(same)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x, y = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(x: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of sorted ``x`` with each of ``sets``."""
    y = np.concatenate(sets)
    hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
    return np.add.reduceat(hit, np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]))


def near_pairs(side: np.ndarray, n: np.ndarray, label: np.ndarray, sketches: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Left members, right members, Hamming distances and which pairs are of two components and within the bound; strip by strip."""
    a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(a) or not len(b):
        return
    sk = _folded(sketches, min(map(len, sketches)))
    strip = max(1, min(128, (4 << 20) // len(b)))
    for at in range(0, len(a), strip):
        i = a[at : at + strip]
        far = np.zeros((len(i), len(b)), np.int64)
        step = max(1, (1 << 18) // far.size)
        for k in range(0, sk.shape[1], step):
            far += np.bitwise_count(sk[i, None, k : k + step] ^ sk[None, b, k : k + step]).sum(axis=2, dtype=np.int64)
        yield i, b, far, (far <= (n[i][:, None] + n[b][None, :]) // 9) & (label[i][:, None] != label[b][None, :])


def block_links(percent: int, key: int, side: np.ndarray, cls: np.ndarray, label: np.ndarray, tokens: list[np.ndarray], sketches: list[np.ndarray], opens: list[list[int]]) -> list[tuple[int, int]]:
    """A forest of links between the components (``label``) of a block's left and right members.

    A pair is left to the first group that both are in, so it is verified in one block only;
    near ones are verified first, and pairs that are joined already are not.
    """
    n = np.array([len(t) for t in tokens])
    before = [frozenset(x for x in o if x < key) for o in opens]
    label = label.copy()
    links = []
    for i, b, far, near in near_pairs(side, n, label, sketches):
        for row, p in enumerate(i):
            q = b[near[row]]
            q = q[np.argsort(far[row][near[row]], kind="stable")]
            size = 4
            while len(q := q[label[q] != label[p]]):
                now, q = q[:size], q[size:]
                size = min(2 * size, max(1, (2 << 20) // int(n.max())))
                now = [x for x in now.tolist() if before[p].isdisjoint(before[x])]
                if not now:
                    continue
                both = _common(tokens[p], [tokens[x] for x in now])
                for x, c in zip(now, both.tolist()):
                    if 100 * c >= percent * (n[p] + n[x] - c) and label[x] != label[p]:
                        links.append((int(cls[p]), int(cls[x])))
                        label[label == label[x]] = label[p]
    return links


def _each_block(f, numbers: list[str], lists: list[str]):
    """``f`` of each block's columns; rows come sorted by block and one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict] = []
        last = None
        for b in batches:
            cols = {c: b.column(c).to_numpy() for c in ("key", "i", "j", *numbers)}
            if "opens" in b.schema.names:
                cols["opens"] = b.column("opens").to_pylist()
            for c in lists:
                data, off = flat(b.column(c))
                data, off = data.view(_U), (off // 8).tolist()
                cols[c] = [data[x:y] for x, y in zip(off[:-1], off[1:])]
            key, i, j = cols["key"], cols["i"], cols["j"]
            cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                if y > x:
                    name = (key[x], i[x], j[x])
                    if parts and name != last:
                        yield from f(parts)
                        parts = []
                    last = name
                    parts.append({c: v[x:y] for c, v in cols.items()})
        if parts:
            yield from f(parts)

    return run


def _whole(parts: list[dict]) -> dict:
    """A block's columns in one piece."""
    if len(parts) == 1:
        return parts[0]
    return {c: sum((p[c] for p in parts), []) if isinstance(parts[0][c], list) else np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _near_members(parts: list[dict]) -> Iterator[pa.RecordBatch]:
    """Members with a near one in another component."""
    t = _whole(parts)
    hit = np.zeros(len(t["cls"]), bool)
    for i, b, _, near in near_pairs(t["side"], t["n"], t["label"], t["sketch"]):
        hit[i] |= near.any(axis=1)
        hit[b] |= near.any(axis=0)
    if hit.any():
        found = np.unique(t["cls"][hit])
        yield pa.record_batch([pa.array(np.full(len(found), t["key"][0])), pa.array(found)], ["key", "cls"])


def _forest(percent: int):
    def run(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        t = _whole(parts)
        if links := block_links(percent, int(t["key"][0]), *[t[c] for c in ("side", "cls", "label", "tokens", "sketch", "opens")]):
            x, y = np.array(links, np.int64).T
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _blocks(marked: DataFrame, row_bytes: list[int]) -> DataFrame:
    """(key, i, j, side, cls, label): in groups of several components the members outside the largest (left) meet all (right); one of groups with the same members is enough.

    Chunks hold at most ``BLOCK_ROWS`` members and ``BLOCK_BYTES`` (``row_bytes``: of a member, by band).
    """
    by_label = marked.groupBy("key", "label").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"h{i}") for i in (1, 2)])
    open_keys = by_label.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("top"), *[F.bit_xor(h).alias(h) for h in ("h1", "h2")]).filter("top.n < m")
    open_keys = open_keys.groupBy("m", "h1", "h2").agg(F.min(F.struct("key", "top")).alias("one")).select("m", "one.*")
    rows = F.lit(BLOCK_ROWS)
    for i, n in enumerate(row_bytes):
        if (most := BLOCK_BYTES // n) < BLOCK_ROWS:
            rows = F.when(F.col("key").bitwiseAND(63) == i, max(16, most)).otherwise(rows)
    chunks = [F.ceil(x / rows).cast("int").alias(c) for x, c in ((F.col("m") - F.col("top.n"), "r"), (F.col("m"), "c"))]
    members = marked.join(open_keys.select("key", F.col("top.label").alias("largest"), *chunks), "key")
    rest = F.col("label") != F.col("largest")

    def spot(i: Column, j: Column, side: int) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))

    c, r = F.pmod(F.xxhash64("cls"), F.col("c")), F.pmod(F.xxhash64("cls", F.lit(1)), F.col("r"))
    left = F.when(rest, F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: spot(r, j, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    right = F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda i: spot(i, c, 1))
    single = F.when(rest, F.array(spot(F.lit(0), F.lit(0), 2))).otherwise(F.array(spot(F.lit(0), F.lit(0), 1)))
    at = F.when((F.col("c") == 1) & (F.col("r") == 1), single).otherwise(F.concat(left, right))
    return members.select("key", "cls", "label", F.explode(at).alias("at")).select("key", "at.*", "cls", "label")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(cls, label) of every linked class: label is the least class that links reach.

    Labels spread to neighbours and then jump to their label's label, so long chains take
    a number of rounds that grows with the logarithm of their length.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = written(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("least"))
        step = labels.join(near, "cls").select("cls", "label", F.least("label", "least").alias("next"))
        up = labels.select(F.col("cls").alias("next"), F.col("label").alias("jump"))
        moved = written(step.join(up, "next", "left").select("cls", "label", F.least("next", F.coalesce("jump", "next")).alias("next")), f"{name}-labels")
        labels = moved.select("cls", F.col("next").alias("label"))
        if moved.filter("label <> next").isEmpty():
            return labels


def near_duplicate_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable by links of Jaccard >= 0.8)."""
    percent = 80  # the bands' bounds are for this value
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(id_or_last(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    sets = written(rows.mapInArrow(_sets, SETS), "sets")
    bits = [f"s{i}" for i in range(BITS // 64)]
    per_class = sets.filter("n > 0").groupBy("cls").agg(F.min(F.struct("doc", "th")).alias("rep"), *[F.first(c).alias(c) for c in ("n", "own", "spare0", "spare1", *bits)])
    per_class = written(per_class.select("cls", F.col("rep.doc").alias("rep"), F.col("rep.th").alias("rep_th"), "n", "own", "spare0", "spare1", *bits), "classes")

    keys = rows.select("text").mapInArrow(_keys, "key long, cls long, many boolean")
    dealt = keys.repartition(parts, "key", F.when(F.col("many"), F.col("cls"))).sortWithinPartitions("key")
    groups = written(dealt.mapInArrow(_shared, "key long, cls long").distinct(), "groups")
    spare = per_class.select("cls", "own", "spare0", "spare1")
    sizes = groups.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    ranked = groups.join(sizes, "key").join(spare, "cls").withColumn("band", F.col("key").bitwiseAND(63).cast("int"))
    each = W.partitionBy("cls", "band")
    ranked = ranked.withColumn("rank", F.row_number().over(each.orderBy(F.desc("size"), "key"))).withColumn("central", F.sum("size").over(each))
    kept = ranked.filter(F.col("rank") > F.when(F.col("band") == F.col("own"), F.col("spare0")).otherwise(F.col("spare1"))).select("key", "cls", "central")
    kept = written(kept, "kept-groups")

    leads = kept.groupBy("key").agg(F.min("cls").alias("least"), F.max("cls").alias("greatest"), F.max(F.struct("central", "cls"))["cls"].alias("most")).filter("least < greatest")
    star = kept.join(leads, "key").select(F.explode(F.array(*[F.struct(F.least("cls", x).alias("a"), F.greatest("cls", x).alias("b")) for x in ("least", "most")])).alias("p"))
    star = star.select("p.a", "p.b").filter("a < b").distinct()

    def sketches(side: str) -> DataFrame:
        return per_class.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), *[F.col(c).alias(f"{c}{side}") for c in bits])

    far = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in bits[1:]), F.bit_count(F.col(f"{bits[0]}a").bitwiseXOR(F.col(f"{bits[0]}b"))))
    near = star.join(sketches("a"), "a").join(sketches("b"), "b").filter(far <= F.floor((F.col("na") + F.col("nb")) / 9)).select("a", "b")

    wanted = kept.select("cls").distinct().join(per_class.select("cls", "own", F.col("rep").alias("doc"), F.col("rep_th").alias("th")), "cls")
    # null and repeated ids are told apart by their texts' hashes
    found = rows.join(wanted.hint("shuffle_hash"), ["doc", "th"]).select("cls", "own", "text")
    tokens = found.mapInArrow(_exact_sets, "cls long, tokens binary, sketch binary").dropDuplicates(["cls"])
    tokens = written(tokens, "tokens")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a = tokens.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
        b = tokens.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
        return written(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a long, b long"), name)

    links = verified(near, "star-links")
    labels = components(links)
    marked = written(kept.join(labels, "cls", "left").select("key", "cls", F.coalesce("label", "cls").alias("label")), "marked-groups")

    def dealt(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    top = (_TOP + _TOP // 4).tolist()
    blocks = _blocks(marked, (BAND_BITS // 4).tolist()).join(per_class.select("cls", "n"), "cls").join(tokens.select("cls", "sketch"), "cls")
    near = written(dealt(blocks).mapInArrow(_each_block(_near_members, ["side", "cls", "label", "n"], ["sketch"]), "key long, cls long").distinct(), "near-members")
    opens = near.groupBy("cls").agg(F.collect_set("key").alias("opens"))
    blocks = _blocks(marked.join(near, ["key", "cls"], "left_semi"), [16 * n for n in top]).join(tokens.join(opens, "cls"), "cls")
    more = written(dealt(blocks).mapInArrow(_each_block(_forest(percent), ["side", "cls", "label"], ["tokens", "sketch"]), "a long, b long").distinct(), "block-links")
    if not more.isEmpty():
        labels = components(links.union(more))

    least = labels.join(per_class.select("cls", "rep"), "cls").groupBy("label").agg(F.min("rep").alias("component"))
    by_label = labels.join(least, "label").select("cls", "component")
    named = per_class.select("cls", "rep").join(by_label, "cls", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    out = sets.select("doc", "n", "cls").join(named, "cls", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))
    return out.select(null_back("doc").alias(id_col), "n_shingles", null_back("component").alias("component_id"))
