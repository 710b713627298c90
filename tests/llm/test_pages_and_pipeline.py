"""URL filters, WARC archives and the pipeline against brute force."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

URLS = [
    (1, "http://WWW.Example.org/es/x?q=1"), (2, "https://a.example.org/en/123#f"), (3, "https://b.example.org/fr/"), (4, "http://x.com/fr/1"), (5, "http://x.com/de/1"),
    (6, "http://listed.net/page/"), (7, "http://www.listed.net:80/page?x"), (8, "http://other.net/page"), (9, None), (10, ""), (11, "no scheme"), (12, "http://com/fr/"), (13, "ftp://xorg/"), (14, "http://org"), (15, "http://listed.net/page"),
    (15, "http://listed.net/page"), (None, "http://listed.net/page#z"), (16, "http://y.com/fr"), (17, "http://Ü.org/ü"), (18, "x://a://b/c"),
]


def test_url_verdicts(spark):
    from tidewheel.llm.urlfilter import RULES, url_verdicts

    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit(0)).withColumn("rule", F.lit(1))
    listed = spark.createDataFrame([("https://listed.net/page",), ("https://listed.net/page/",), (None,), ("http://b.example.org/fr",)], "url string")

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        tail = rest[cut:]
        end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]

    want = []
    for i, u in URLS:
        host, path = split(u)
        fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fit, key=len, default=None)
        bad = host.removeprefix("www.").removesuffix(":80") + path.rstrip("/") in ("listed.net/page", "b.example.org/fr")
        want.append((i, host, path, rule, RULES[rule] if rule else "block" if bad else "allow"))
    for blocks in (1 << 16, 1):
        got = url_verdicts(pages, listed, max_blocks=blocks).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_verdicts(pages.limit(0), listed).count() == 0
    assert url_verdicts(pages, listed.limit(0)).filter("listed").count() == 0


def test_bloom_loses_none_and_rules_out_most(spark):
    from tidewheel.llm.urlfilter import url_verdicts

    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".net/p")).alias("url"))
    got = url_verdicts(pages, pages.filter("page_id % 10 = 0").select("url"))
    assert got.filter("listed").count() == 400 and got.filter("listed and page_id % 10 <> 0").count() == 0
    assert got.filter("possible_hit").count() < 440


PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\r\nEvil: 1", ""), (5, "http://d/", "é" * 5000), (6, "http://e/" + "u" * 9000, "y\r\n\r\nz"), (None, "http://f/", "<p>x</p>"), (None, "q", "only null id"), (7, "http://g/", "dup row"), (7, "http://g/", "dup row")]


def expected(rows, least=0):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and len(raw) >= least and top[h or ""] > i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    from tidewheel.llm.warc import warc_round_trip

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("payload", F.lit(2)).repartition(3)
    got = warc_round_trip(pages, f"file://{tmp_path}/w", min_bytes=least).collect()
    assert sorted(map(str, map(tuple, got))) == expected(PAGES, least)
    assert warc_round_trip(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_warc_reader(spark, tmp_path):
    """Payloads survive; predicates reach the reader; stray files, plain files and foreign gzip members are handled."""
    import gzip

    from pyspark.sql.datasource import EqualTo, In

    from tidewheel.llm.warc import WarcReader, archive_records, record, register

    register(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/w"
    archive_records(pages).write.format("warc").mode("append").save(path)
    (tmp_path / "w" / "part-stray.warc.gz").write_bytes(b"left by a lost task")
    back = spark.read.format("warc").load(path)
    assert back.count() == len(PAGES)
    kept = {r.record_id: bytes(r.payload) for r in back.filter("record_type = 'response'").collect()}
    assert kept["urn:page:5"] == ("é" * 5000).encode() and kept["urn:page:6"] == b"y\r\n\r\nz" and kept["urn:page:4"] == b""
    assert back.filter("record_type = 'revisit'").count() == 2
    reader = WarcReader({"path": path})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("payload_bytes",), (10000,)), EqualTo(("payload",), b"x")]))
    assert len(rest) == 1
    rows = [r for p in reader.partitions() for r in reader.rows(p.path)]
    assert [r[0] for r in rows] == ["urn:page:5"]
    raw = [record("response", f"urn:page:{i}", "u", "1970-01-01T00:00:00Z", b"p" * n, base64.b32encode(hashlib.sha1(b"p" * n).digest()).decode(), None) for i, n in enumerate([0, 10, 9000])]
    (tmp_path / "plain.warc").write_bytes(b"".join(raw))
    (tmp_path / "foreign.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw))
    for name in ("plain.warc", "foreign.warc.gz"):
        got = spark.read.format("warc").option("verify", "true").load(f"{tmp_path}/{name}").collect()
        assert [(r.record_id, len(r.payload), r.payload_bytes) for r in got] == [(f"urn:page:{i}", n, n) for i, n in enumerate([0, 10, 9000])]


def test_gzip_member_is_standard():
    import gzip

    from tidewheel.llm.warc import member

    raw = b"abc" * 1000
    m = member(raw, 1)
    assert gzip.decompress(m) == raw and struct.unpack("<II", m[16:24]) == (len(m), len(raw))


def _documents(rng):
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, text(20)) for i in range(5)]
    rows = [(i, text(int(rng.integers(55, 400)))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + " tail"), (102, text(30)), (103, "same " * 100), (104, text(60) + " " + items[2][1] + " " + text(40)), (105, text(60) + " password = hunter2hunter2 " + text(10)), (106, None), (107, "")]
    return rows, items


def test_pipeline(spark, tmp_path):
    """run() against the stages done by hand: what goes, what stays, and the pieces' ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows, items = _documents(np.random.default_rng(1))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = {100, 101, 102, 103, 104, 106, 107}  # copies, too short, repetitive, contaminated, empty
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns and stage.dtypes == docs.dtypes
    texts = {r.doc_id: r.text for r in stage.collect()}
    assert set(texts) == {i for i, _ in rows} - gone
    changed = {i for i, t in rows if i in texts and texts[i] != t}
    assert changed == {105} and "hunter2" not in texts[105] and "[secret]" in texts[105]
    assert stage.filter("n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [p.ids_crc32 for p in mine] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine]
        assert sum(p.length for p in mine) == len(ids)
    assert {p.doc_id for p in pieces} == set(texts)


def test_pipeline_takes_null_and_repeated_ids(spark, tmp_path):
    """One row of each group stays and no contaminated row does, whatever the ids."""
    import corpus_pipeline

    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    a, b, c, d, item = text(120), text(90), text(80), text(70), text(20)
    leak = text(60) + " " + item + " " + text(30)
    rows = [(None, a), (None, a + " tail"), (None, b), (7, b), (8, c), (8, c), (9, d), (9, text(75)), (None, leak), (10, leak + " end"), (None, text(65)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    copies = [r for r in got if r[1] in (a, a + " tail")]
    assert len(copies) == 1 and copies[0][0] is None
    want = [r for r in rows if r[1] not in (a, a + " tail")]
    for gone in ((None, b), (8, c), (None, leak)):
        want.remove(gone)
    assert sorted((r for r in got if r not in copies), key=str) == sorted(want, key=str)
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted((r for r in rows if r not in ((None, leak), (10, leak + " end"))), key=str)
