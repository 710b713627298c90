"""Hard negatives, spelling variants and token files against brute force."""

import io
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC = "doc_id long, text string"


# hard negatives


def mined(rows, **kw):
    """Rows (id, label, vector, is anchor) -> results, by comparing all."""
    p, n, low, high, of = kw.get("positives", 5), kw.get("negatives", 10), 3, 9, 10
    ok = [(i, lab, [max(-(1 << 22), min(1 << 22, math.floor(256 * x))) for x in v], a) for i, lab, v, a in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (i, lab, v, a) in enumerate(ok):
        if i is None or i % 20:
            continue
        others = [(sum(map(lambda x, y: x * y, v, w)), j, m) for q, (j, m, w, _) in enumerate(ok) if q != k]
        same = sorted((r for r in others if r[2] == lab), key=key)[:p]
        for ps, pid, _ in same:
            window = sorted((r for r in others if r[2] != lab and low * ps <= of * r[0] <= high * ps), key=key)[:n]
            out += [(i, pid, rank, nid, ps, ns) for rank, (ns, nid, _) in enumerate(window, 1)]
    return sorted(map(str, out))


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("chunk", T.StringType()), T.StructField("anchor", T.StringType())])


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, lab, v, "clash", "x") for i, lab, v, _ in rows], VECTORS).repartition(parts)


def some_vectors():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    rows = []
    for i in range(260):
        v = (centre[i % 6] + rng.normal(size=8) * rng.choice([0.01, 0.3, 1.0])).astype(np.float32).tolist()
        rows.append((i, int(i % 6 if rng.random() < 0.7 else rng.integers(0, 6)), v, i % 20 == 0))
    rows += [(1000 + k, k % 3, rows[7][2], False) for k in range(40)]  # copies of a vector under several labels: ties
    rows += [(40, rows[40][1], rows[40][2], True), (40, rows[40][1], rows[40][2], True)]  # repeated anchors
    rows += [(None, 1, rows[9][2], False), (None, 2, rows[9][2], False), (300, None, rows[9][2], False), (301, 1, None, False), (302, 1, [1.0, None], False), (303, 1, [float("nan")] * 8, False), (304, 1, [float("inf")] * 8, False)]
    rows += [(305, 1, [], False), (306, 2, [1.0, 2.0], False), (320, 2, [0.5, -0.25, 1.0], True), (307, 1, [3e30] * 8, False), (340, 3, [-3e30, 3e30] * 4, True), (360, 4, [], True), (380, 9, rows[3][2], True)]
    return rows


@pytest.mark.parametrize("kw", [{}, {"chunk_rows": 7, "block_anchors": 3}, {"positives": 2, "negatives": 1, "pass_bytes": 400, "chunk_rows": 64, "block_anchors": 4}])
def test_hard_negatives(spark, kw):
    from tidewheel.llm.negatives import mine_hard_negatives

    rows = some_vectors()
    got = mine_hard_negatives(vectors(spark, rows), anchor=F.col("vec_id") % 20 == 0, **kw)
    assert got.schema.simpleString() == "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"
    assert sorted(str(tuple(r)) for r in got.collect()) == mined(rows, **kw)


def test_hard_negatives_of_nothing(spark):
    from tidewheel.llm.negatives import mine_hard_negatives

    rows = some_vectors()
    assert mine_hard_negatives(vectors(spark, []), anchor=F.col("vec_id") % 20 == 0).collect() == []
    assert mine_hard_negatives(vectors(spark, rows), anchor=F.lit(None).cast("boolean")).collect() == []


def test_tree_bounds_spare_scores():
    """Near anchors' windows are found without scoring all rows again."""
    from tidewheel.llm.negatives import _Block, _walk, spanning_tree

    rng = np.random.default_rng(2)
    anchors = rng.integers(-200, 200, 8) + rng.integers(-1, 2, (50, 8))
    order, parent = spanning_tree(anchors)
    v = anchors[order]
    assert parent[0] == -1 and all(p < k for k, p in enumerate(parent))
    block = _Block.__new__(_Block)
    block.ids, block.v, block.parents = np.arange(50), v.astype(np.int32), parent
    block.edges = np.where(parent >= 0, np.sqrt(((v - v[parent]) ** 2).sum(axis=1)), 0)
    block.norm = float(np.sqrt((v.astype(float) ** 2).sum(axis=1).max()))
    rows = rng.integers(-200, 200, (3000, 8)).astype(np.int32)
    low, high, got = 20_000, 40_000, {}
    scored = _walk(block, rows, lambda a, lo, hi: (hi >= low) & (lo <= high), lambda a, on, s: got.update({a: {(int(r), int(x)) for r, x in zip(on, s) if low <= x <= high}}))
    for a in range(50):
        s = rows.astype(int) @ v[a]
        assert got.get(a, set()) == {(int(r), int(s[r])) for r in np.flatnonzero((s >= low) & (s <= high))}
    assert scored < 0.5 * 50 * 3000


# spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def grouped(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(map(str, out))


def test_variant_words(spark):
    from tidewheel.llm.spelling import variant_words

    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("abcdefÀéß×ÿZQ"), rng.integers(5, 12))) for _ in range(60)]
    rows = [(k if k % 5 else None, " ".join(rng.choice(vocab, 80)) + rng.choice([", ", "7", "x-y", "Ā"])) for k in range(60)]
    rows += [(7, None), (8, ""), (9, "abcdefgh " * 3000), (9, "abcdefgh " * 3000), (10, "q" * 30_000), (11, "q" * 30_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOC + ", word string").repartition(3)
    got = {r["word"]: r["n"] for r in variant_words(docs).collect()}
    assert got == counted(rows)


def test_group_variants(spark):
    from tidewheel.llm.spelling import group_variants, near_words

    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abé"), 8)) for _ in range(25)] + ["statement", "restated", "aaaaaaa", "abababab", "nationality"]
    n = {}
    for w in base:
        n[w] = int(rng.choice([3000, 300, 30, 2]))
        for _ in range(5):
            v = list(w)
            for _ in range(rng.integers(1, 3)):
                k = int(rng.integers(0, len(v)))
                v[k : k + 1] = [[], ["a"], ["x"], [v[k], "b"]][rng.integers(0, 4)]
            n.setdefault("".join(v), int(rng.choice([2, 3, 25, 200])))
    n |= {"a" * k: 2 * 11 ** (14 - k) for k in range(7, 14)}  # a chain of forms, prefixes of each other
    long = "".join(rng.choice(list("abcdefgh"), 4000))
    n |= {long: 50, long[:10] + long[11:]: 2, long[:3990] + "z" + long[3991:]: 3, long[:2000] + "z" + long[2001:]: 4, long + "q": 5, "q" + long: 5}
    n = {w: c for w, c in n.items() if len(w) >= 7}
    words = spark.createDataFrame([(w, c, "clash") for w, c in n.items()], "word string, n long, s string").repartition(3)
    got = group_variants(words)
    assert sorted(str((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"])) for r in got.collect()) == grouped(n)
    pairs = {tuple(r) for r in near_words(words).collect()}
    assert pairs == {(a, b) for a, b in itertools.permutations(n, 2) if one_edit(a, b)}


def test_group_variants_of_nothing(spark):
    from tidewheel.llm.spelling import group_variants, variant_words

    assert group_variants(variant_words(spark.createDataFrame([], DOC))).collect() == []
    with pytest.raises(ValueError, match="frequent"):
        group_variants(spark.createDataFrame([], "word string, n long"), ratio=1)


# token files


ODD = "a\x1cb Don'T we're <|endoftext|>x Ünïcode× ΣΑΣ ŉ İ !'s 3rd <|startoftext|> ﬁ   x\u0085y é ' 'S '' x'll"


def token_rows():
    rng = np.random.default_rng(8)
    vocab = ["Zebra,", "zebra", "don't", "É", "naïve", "x1y2", "...", "日本語", "word"]
    rows = [(k, " ".join(rng.choice(vocab, rng.integers(0, 60)))) for k in range(80)]
    rows += [(90, None), (91, ""), (92, ODD), (None, "last one"), (None, None), (5, "again"), (5, "again"), (-3, "first"), (95, "Zebra, don't stop. " * 20_000), (96, "q" * 30_000)]
    return rows


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_token_round_trip(spark, tokenizer):
    from tidewheel.llm.tokenfile import token_round_trip

    rows = token_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOC + ", hash string, row int").repartition(4)
    got = sorted(map(tuple, token_round_trip(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    want = [(i, len(x), zlib.crc32(x)) for i, t in rows for x in [encoded(tokenizer, t)]]
    assert sorted(map(str, ((r[0], r[2], r[3]) for r in got))) == sorted(map(str, want))
    assert token_round_trip(spark.createDataFrame([], DOC)).collect() == []


def test_encoder_is_the_tokenizer(tokenizer):
    """Also with a table of few places, where runs drive each other out, and over all code points of the first plane."""
    import public_tokenizers
    import pyarrow as pa

    from tidewheel.llm.tokenfile import Encoder
    from tidewheel.llm.words import flat

    texts = [t or "" for _, t in token_rows()] + [ODD.replace(" ", c) for c in " 　\x0b\x1d﻿"]
    texts += ["".join(chr(c) + ("a" if c % 3 else " ") for c in range(a, a + 512) if not 0xD800 <= c < 0xE000) for a in range(1, 0x10000 - 512, 512)]
    for slots in (8, 1 << 12):
        encode = Encoder(public_tokenizers.path("word_bpe_49k.json"), 1, slots)
        for part in (texts, texts[::-1], texts[:3]):
            ids, off = encode(*flat(pa.array(part)))
            assert len(off) == len(part) + 1
            for t, a, b in zip(part, off, off[1:]):
                assert np.array_equal(ids[a:b], encoded(tokenizer, t)), t


def test_encoder_learns_parts_once(tokenizer):
    """Capitals, signs and digits around known words need no more of the tokenizer; a full table keeps what it leads to."""
    import public_tokenizers
    import pyarrow as pa

    from tidewheel.llm.tokenfile import Encoder
    from tidewheel.llm.words import flat

    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcdefghijklmnopé\u00df"), 6)) for _ in range(200)})
    tails = ["", ",", ".", ")...", "-x", "7", "42", "!?"]
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Encoder(path, 1, 1 << 12)
    asked = []
    encode.part = lambda p, part=encode.part: asked.append(p) or part(p)
    encode.whole = lambda runs, whole=encode.whole: asked.extend(runs) or whole(runs)
    for case in (str, str.capitalize, str.upper):
        texts = [case(w) + t for t in tails for w in words if case(w).lower() == w] + ["", " "]
        ids, off = encode(*flat(pa.array(texts)))
        for t, a, b in zip(texts, off, off[1:]):
            assert np.array_equal(ids[a:b], encoded(tokenizer, t)), t
    assert len(asked) <= 1.2 * (len(words) + 20)
    for k in range(30):
        new = [" ".join("".join(rng.choice(list("qrstuvwxyz"), 8)) for _ in range(100)) for _ in range(10)]
        for texts in (new, words):
            asked.clear()
            ids, off = encode(*flat(pa.array(texts)))
            assert all(np.array_equal(ids[a:b], encoded(tokenizer, t)) for t, a, b in zip(texts, off, off[1:]))
        assert encode.n <= 2 * 4096 + 1100 and len(asked) <= len(words) // 2
    assert [x.tolist() for x in encode(*flat(pa.array(["", None])))] == [[1, 1], [0, 1, 2]]


def test_token_files_read_what_is_asked_for(spark, tokenizer, tmp_path):
    from tidewheel.llm.tokenfile import FrameReader, register, write_token_files

    docs = spark.createDataFrame([(k, f"word{k} " * 50) for k in range(400)], DOC)
    path = str(tmp_path / "ids")
    write_token_files(docs, path, frame_bytes=1000)
    register(spark)
    back = spark.read.format("tokens").load(path)
    assert back.count() == 400
    for cond, want in (("doc_id = 17", {17}), ("doc_id in (3, 250)", {3, 250}), ("doc_id >= 395 and doc_id < 398", {395, 396, 397}), ("doc_id > 9999", set()), ("doc_id is null", set())):
        rows = back.filter(cond).collect()
        assert {r["doc_id"] for r in rows} == want
        for r in rows:
            assert np.array_equal(np.frombuffer(r["ids"], "<u4"), encoded(tokenizer, f"word{r['doc_id']} " * 50))
    name = sorted(p for p in (tmp_path / "ids").iterdir() if p.name.endswith(".zst"))[0]
    raw = name.read_bytes()
    reader = FrameReader(io.BytesIO(raw), len(raw))
    assert len(reader.packed) > 10
    middle = len(reader.docs) // 2
    reader.ids(middle)
    assert reader.decoded <= 2
    import zstandard

    plain = b"".join(reader.ids(k) for k in range(len(reader.docs)))
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == plain
    broken = bytearray(raw)
    broken[int(reader.begin[2]) + int(reader.packed[2]) - 3] ^= 0x10
    with pytest.raises((ValueError, zstandard.ZstdError)):
        r = FrameReader(io.BytesIO(bytes(broken)), len(raw))
        [r.ids(k) for k in range(len(r.docs))]


def test_uncommitted_token_files_are_not_read(spark, tmp_path):
    from tidewheel.llm.tokenfile import register, write_token_files

    path = tmp_path / "ids"
    write_token_files(spark.createDataFrame([(1, "one")], DOC), str(path))
    next(p for p in path.iterdir() if p.name.endswith(".zst")).with_name("part-lost.ids.zst").write_bytes(b"half a file")
    write_token_files(spark.createDataFrame([(2, "two words")], DOC), str(path))
    register(spark)
    assert {r["doc_id"] for r in spark.read.format("tokens").load(str(path)).collect()} == {1, 2}
