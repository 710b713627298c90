"""Feeds, selection, dedup, dispatch, state, reports and streams on small fixtures."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import offers as O
from tidewheel.operators import dedup, dispatch, extract, report, select, state
from tidewheel.sources import captures, feeds
from tidewheel.streaming import jobs

NOW = dt.datetime(2026, 8, 28, 12)
AS_OF = None


@pytest.fixture(autouse=True, scope="module")
def now(spark):
    global AS_OF
    AS_OF = F.lit("2026-08-28 12:00:00").cast("timestamp")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# --- feeds ---------------------------------------------------------------------------------


def test_rss(spark):
    xml = '<rss><channel><item><title>Free tier</title><link>https://a.io/1</link><description>free credits</description></item><item><title>B</title><link>/relative</link></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Launch of an API</title><link href="https://b.io/2"/><summary>news</summary><id>g1</id></entry></feed>'
    docs = spark.createDataFrame([("f", xml), ("g", atom), ("bad", "<x"), ("null", None)], "feed string, xml string")
    items = feeds.rss_items(docs)
    assert rows_of(items, "feed", "pos", "url", "guid") == [("f", 0, "https://a.io/1", "https://a.io/1"), ("g", 0, "https://b.io/2", "g1")]
    dim = spark.createDataFrame([("f", None), ("g", "tools")], "feed string, category_hint string")
    got = feeds.rss_payloads(items, dim, as_of=AS_OF)
    assert rows_of(got, "external_id", "text") == [("rss:f:0:https://a.io/1", "Free tier\nfree credits"), ("rss:g:0:https://b.io/2", "Launch of an API\nnews")]
    assert rows_of(feeds.launch_payloads(docs, as_of=AS_OF), "external_id") == [("producthunt:g1",), ("producthunt:https://a.io/1",)]


def test_trending_html(spark):
    page = "".join(f'<h2 class="h3 lh-condensed"><a data-x href="/o{i}/r">o / r</a></h2><a href="/login">n</a>' for i in range(40))
    got = feeds.trending_html_repos(spark.createDataFrame([("p", page)], "page string, html string"))
    assert got.count() == 25 and got.filter("pos = 1").first().url == "https://github.com/o1/r"


REPO = "html_url string, full_name string, name string, description string, topics array<string>, homepage string, stargazers_count long, forks_count long, language string, created_at string, pushed_at string, facet_pos int, pos int"


def test_repos(spark):
    def repo(url, name="o/r", home="", stars=99, created="2026-08-20T00:00:00Z", facet=0, pos=0):
        return (url, name, None, "d", ["ai"], home, stars, 1, "Go", created, created, facet, pos)

    a, b, c = (f"https://github.com/o/{x}" for x in "abc")
    data = [repo(a), repo(b, pos=1), repo(b, facet=1), repo(c, facet=1, pos=1, home="https://home"), repo("", pos=2), repo("https://x/n", name=""), repo("https://x/few", stars=3), repo("https://x/old", created="2026-01-01T00:00:00Z")]
    df = spark.createDataFrame(data, REPO)
    got = feeds.repo_payloads(df, as_of=AS_OF)
    assert rows_of(got, "external_id") == [(a,), (b,), (c,)]
    row = got.filter(F.col("external_id") == c).first()
    assert (row.text, row.urls, row.author_handle, json.loads(row.extra)["is_repo"]) == ("o/r (99★): d\nTopics: ai", [c, "https://home"], "github:o", True)
    assert feeds.repo_payloads(df, as_of=AS_OF, max_repos=2).count() == 2


def test_markdown(spark):
    text = "[top](https://t.io) free\n# DNS\n- [a](https://a.io/x) text [gh](https://github.com/x/y)\n## Misc stuff\n- [b](https://b.io)\n- FREE [c](https://c.io) [d](https://d.io)\n"
    links = feeds.markdown_links(spark.createDataFrame([("f", text)], "file string, content string"))
    assert rows_of(links, "line", "section", "url") == [(0, "general", "https://t.io"), (2, "dns", "https://a.io/x"), (5, "misc stuff", "https://c.io"), (5, "misc stuff", "https://d.io")]
    assert feeds.markdown_payloads(links).filter("external_id = 'https://a.io/x'").first().text.startswith("Dns: - [a]")


def test_other_feeds(spark):
    models = spark.createDataFrame([("m/a", "A", "d", 128000, ("0", "0.0")), ("m/b", None, None, None, ("0", "1")), ("m/c", "C", None, None, ("", "0")), ("m/d", "D", "", None, ("x", "0"))], "id string, name string, description string, context_length long, pricing struct<prompt:string,completion:string>")
    got = feeds.free_model_payloads(models, as_of=AS_OF).collect()
    assert [r.external_id for r in got] == ["m/a"] and "Context: 128,000 tokens." in got[0].text
    posts = spark.createDataFrame([("hello http://a.b/c, and", ["http://x.y"], 1), ("", None, 2), ("", ["http://e.f", "http://e.f"], 3)], "text string, entity_urls array<string>, message_id long").selectExpr("'ch' channel", "message_id", "cast(null as string) date", "text", "entity_urls", "1L views", "2L forwards")
    assert rows_of(feeds.message_payloads(posts), "external_id", "urls") == [("1", ["http://x.y", "http://a.b/c,"]), ("3", ["http://e.f"])]
    manual = spark.createDataFrame([("short", [], "h"), ("long enough text", ["http://a"], None), ("long enough text", ["ftp://a"], "h"), ("x" * 4001, [], "h"), ("long enough text", ["http://a"] * 9, "h")], "text string, urls array<string>, author_handle string")
    ok, bad = feeds.manual_payloads(manual, as_of=AS_OF)
    assert rows_of(ok, "author_handle") == [("manual",)] and rows_of(bad, "reject_reason") == [("bad_url",), ("text_too_long",), ("text_too_short",), ("too_many_urls",)]
    site = spark.createDataFrame([("s", "/free/")], "site string, path_fragment string")
    urls = spark.createDataFrame([("s", f"https://s{p}") for p in ("/free/a", "/free/b", "/x", "/y", "/z")], "site string, url string")
    assert feeds.site_pages(urls, site).count() == 2
    ext = spark.createDataFrame([("http://p", "h", True, " Good title ", "d", None, ["do", "it"]), ("http://q", "h", False, "Good title", "d", None, []), ("http://r", "h", True, "abc", "d", None, [])], "scraped_url string, handle string, is_offer boolean, title string, description string, direct_url string, claiming_steps array<string>").selectExpr("*", "'' promo_code", "1.0 value", "'' currency", "'' expires_at", "'' category")
    got = feeds.extract_payloads(ext).collect()
    assert len(got) == 1 and got[0].text == "Good title\nd\n1. do\n2. it" and got[0].urls == ["http://p"] and len(got[0].external_id) == 20
    lanes = spark.createDataFrame([("l", ["t1"]), ("all", [])], "lane string, tags array<string>")
    tpl = spark.createDataFrame([("t1", "q1"), ("t2", "q2"), ("t3", "q3")], "tag string, query string")
    assert feeds.select_templates(tpl, lanes, lane="l").count() == 1 and feeds.select_templates(tpl, lanes, lane="all", gated=["t3"]).count() == 2
    page = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"links": [{"url": "https://good.io/x", "title": "Free pack"}, {"url": "https://youtube.com/c", "title": "me"}, {"link": "mailto:x"}]}}}) + "</script>"
    bio = feeds.bio_payloads(spark.createDataFrame([("h", 0, page), ("e", 1, "none")], "handle string, idx int, html string"), platform="links", as_of=AS_OF).collect()
    assert [(r.external_id, r.text, r.urls) for r in bio] == [("links:h:0:https://good.io/x", "Free pack", ["https://good.io/x"])]
    blocks = json.dumps({"blocks": [{"link": "https://b.io/y", "label": "Free tool"}, {"url": "https://youtube.com/c", "title": "me"}]})
    bio = feeds.bio_payloads(spark.createDataFrame([("h", 0, blocks), ("n", 1, None)], "handle string, idx int, html string"), platform="links", as_of=AS_OF).collect()
    assert [(r.external_id, r.text, r.urls) for r in bio] == [("links:h:0:https://b.io/y", "Free tool", ["https://b.io/y"])]


def test_board_and_articles(spark):
    stamp = int(NOW.timestamp())
    hits = spark.createDataFrame([("1", "T", None, None, "a", "c", 10, 2, stamp, "x", 0, 0), ("1", "T", None, None, "a", "c", 10, 2, stamp, "y", 1, 0), ("2", "U", "body", "http://u", "a", "c", 5, 2, stamp, "x", 0, 1), ("3", "V", "s", "http://v", "a", "c", 9, 0, stamp - 9 * 86400, "x", 0, 2)], "objectID string, title string, story_text string, url string, author string, created_at string, points long, num_comments long, created_at_i long, term string, term_pos int, hit_pos int")
    got = feeds.hn_payloads(feeds.hn_select(hits, as_of=AS_OF)).collect()
    assert [(r.external_id, r.text, r.urls, json.loads(r.extra)["search_term"]) for r in got] == [("1", "T", ["https://news.ycombinator.com/item?id=1"], "x")]
    art = spark.createDataFrame([(1, "t", "d", "http://a", None, ("u",), 9, ["x"], "opensource", 0, 0), (1, "t", "d", "http://a", None, ("u",), 9, ["x"], "ai", 1, 0), (2, "plain", "d", None, "http://c", None, 9, [], "ai", 1, 1), (3, "free", "d", None, "http://c", None, 9, [], "ai", 1, 2), (4, "free", "d", "", None, None, 1, [], "ai", 1, 3)], "id long, title string, description string, url string, canonical_url string, user struct<username:string>, positive_reactions_count long, tag_list array<string>, query_tag string, tag_pos int, pos int").selectExpr("*", "0L comments_count", "'p' published_at", "1L reading_time_minutes")
    assert rows_of(feeds.devto_payloads(art), "external_id", "author_handle", "urls") == [("devto:1", "devto:u", ["http://a"]), ("devto:3", "devto:unknown", ["http://c"])]
    assert feeds.devto_payloads(art, max_items=1).count() == 1


def tweet(i, text, name=None, old=False, **more):
    user = {"legacy": {"screen_name": name}} if old else {"core": {"screen_name": name}}
    return {"legacy": {"id_str": str(i), "full_text": text, "created_at": "Wed Aug 27 12:00:00 +0000 2026", "entities": {"urls": [{"expanded_url": u} for u in more.get("urls", [])]}}, "core": {"user_results": {"result": user}} if name else None}


def test_captures(spark):
    body = {"data": [{"deep": {"tweet": tweet(1, "free http://a.io/x.", "alice")}}, tweet(2, "no link", "bob"), tweet(1, "again http://b.io"), tweet(3, "self", "c", True, urls=["https://x.com/i/1", "http://ok.io"]), tweet(4, "bad http://h" + "/x" * 12), tweet(5, "no author http://z.io")]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "not json"), (3, None)], "capture long, body string")
    got = captures.tweet_payloads(df)
    assert rows_of(got, "external_id", "author_handle", "urls") == [("twitter:1", "twitter:alice", ["http://a.io/x"]), ("twitter:3", "twitter:c", ["http://ok.io"]), ("twitter:5", "twitter:unknown", ["http://z.io"])]
    assert got.filter("published_at <> '2026-08-27T12:00:00+00:00'").count() == 0
    media = {"a": {"code": "C1", "caption": {"text": "go http://a.io"}, "taken_at": 1000, "like_count": 3}, "b": {"shortcode": "C2", "edge_media_to_caption": {"edges": [{"node": {"text": "old http://b.io"}}]}, "edge_liked_by": {"count": 7}}, "c": {"code": "C3", "caption": None}, "d": {"code": "not media"}, "u": {"username": "me", "external_url": "http://bio.io", "biography": "hi"}, "u2": {"username": "me", "external_url": "http://bio.io"}}
    got = captures.media_payloads(spark.createDataFrame([(1, "me", json.dumps(media))], "capture long, handle string, body string"))
    assert rows_of(got, "external_id", "urls") == [("instagram:C1", ["http://a.io"]), ("instagram:C2", ["http://b.io"]), ("instagram:bio:me", ["http://bio.io"])]
    assert rows_of(got, "engagement", "published_at") == [('{"likes":3,"comments":0}', "1970-01-01T00:16:40+00:00"), ('{"likes":7,"comments":0}', None), ("{}", None)]
    page = '<div class="tgme_widget_message_text js">Get <a href="https://good.io">free</a> now</div><div class="x">skip</div><div class="tgme_widget_message_text">chat only</div><div class="tgme_widget_message_text"><a href="https://t.me/x">join</a></div>'
    got = captures.webview_payloads(spark.createDataFrame([("c", page), ("n", None)], "channel string, html string"), as_of=AS_OF)
    assert rows_of(got, "external_id", "text", "urls") == [("tg_web:c:0", "Get free now", ["https://good.io"])]


# --- selection -----------------------------------------------------------------------------------


def tables(spark, n=40):
    raw = spark.range(1, n + 1).selectExpr("id", "id % 3 AS source_id", "cast(id as string) external_id", "cast(null as string) raw_payload", "timestamp'2026-08-01' + make_dt_interval(0, cast(id as int)) fetched_at", "0 attempts", "cast(null as timestamp) last_attempted_at", "cast(null as string) last_reject_reason", "id = 5 permanently_rejected")
    sources = spark.createDataFrame([(0, "s0", "web", True), (1, "s1", "web", True), (2, "s2", "web", False)], "id long, name string, kind string, enabled boolean")
    offers = spark.createDataFrame([(1, 3)], "id long, raw_item_id long")
    return raw, sources, offers


@pytest.mark.parametrize("value, want", [(None, 0.5), ("junk", 0.5), (0.25, 0.25), (5, 1.0), (-3, 0.0)])
def test_fraction(value, want):
    assert select.clamp_fraction(value) == want


def test_fetch(spark):
    raw, sources, offers = tables(spark)
    pool = [i for i in range(1, 41) if i % 3 != 2 and i not in (3, 5)]
    for limit, frac in ((10, 0.5), (10, 0.0), (7, 0.25), (100, 0.5), (0, 0.5)):
        old = int(limit * frac)
        want = {*pool[:old], *(pool[-(limit - old) :] if limit > old else [])}
        assert {r.id for r in select.fetch_unprocessed(raw, sources, offers, limit=limit, oldest_fraction=frac).collect()} == want
    assert {r.source_name for r in select.fetch_unprocessed(raw, sources, offers, limit=10, source="s1").collect()} == {"s1"}


def test_caps(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i, f"t{rng.integers(4)}", f"k{rng.integers(20)}") for i in range(200)]
    df = spark.createDataFrame(rows, "run int, pos long, tag string, key string")
    got = {(r.run, r.pos) for r in select.cap_sequential(df, run="run", order="pos", tag="tag", key="key", per_tag=3, total=9).collect()}
    want = set()
    for run in (0, 1):
        seen, used, n = set(), {}, 0
        for r in rows:
            if r[0] == run and r[3] not in seen and used.get(r[2], 0) < 3 and n < 9:
                seen.add(r[3])
                used[r[2]] = used.get(r[2], 0) + 1
                n += 1
                want.add(r[:2])
    assert got == want
    assert select.cap_per_group(df, "tag", "pos", per_group=5, total=12).count() == 12


def test_batches_and_replies(spark):
    items = spark.createDataFrame([("deal", i, f"text {i}", ["http://u"] * 9) for i in range(5)], "mode string, n int, text string, urls array<string>")
    numbered = select.batches(items, mode="mode", order="n", size=2)
    prompts = extract.batch_prompts(numbered).orderBy("batch").collect()
    assert [p.posts for p in prompts] == [2, 2, 1] and prompts[0].prompt.startswith("[POST 1]\nURLs: " + ", ".join(["http://u"] * 6)) and "\n\n[POST 2]" in prompts[0].prompt
    replies = spark.createDataFrame([("deal", 0, '{"results": [{"a": 1}, {"a": 2}]}'), ("deal", 1, '```json\n[{"a": 3}]\n```'), ("deal", 2, '[{"a": 4}]')], "mode string, batch int, reply string")
    got = {r.n: r.json for r in extract.parse_batch_replies(replies, numbered).collect()}
    assert [json.loads(got[i])["a"] if got[i] else None for i in range(5)] == [1, 2, None, None, 4]


def test_normalize_and_decide(spark):
    raw = spark.createDataFrame([(1, 0, "e", json.dumps({"text": "<b>Deal</b> http://a.b/c", "urls": ["http://x.y"], "author_handle": "h", "engagement": {"views": 3}, "extra": {"is_repo": True}})), (2, 0, "f", None)], "id long, source_id long, external_id string, raw_payload string")
    got = {r.raw_item_id: r for r in extract.prefilter(extract.normalize_items(raw, tables(spark)[1])).collect()}
    assert (got[1].text, got[1].urls, json.loads(got[1].engagement)) == ("Deal http://a.b/c", ["http://a.b/c", "http://x.y"], {"views": 3})
    assert (got[2].text, got[2].urls, got[2].prefilter) == ("", [], "prefilter:too_short")
    cases = [((["u"], "", "live", True, [], None, None), "written", False), (([], "", None, True, [], None, None), "no_url", True), ((["u"], "p", None, True, [], None, None), "prefiltered", True), ((["u"], "", "dead", True, [], None, None), "rejected", True), ((["u"], "", "unreachable", True, [], None, None), "written", False), ((["u"], "", "live", False, [], None, None), "retry", False), ((["u"], "", "live", True, ["title"], None, None), "rejected", True), ((["u"], "", "live", True, [], "url", None), "dup", True), ((["u"], "", "live", True, [], None, "x"), "error", False)]
    df = spark.createDataFrame([c[0] for c in cases], "urls array<string>, prefilter string, liveness string, reply_seen boolean, reject_reasons array<string>, dup_basis string, error string").coalesce(1)
    assert [(r.outcome, r.permanent) for r in extract.decide(df).collect()] == [c[1:] for c in cases]
    res = spark.createDataFrame([("http://s", "https://www.f.io/?utm_x=1")], "original string, final string")
    assert rows_of(extract.canonicalize(spark.createDataFrame([("http://s",), ("http://t/",)], "url string"), res), "url", "canonical_url") == [("http://s", "https://f.io/"), ("http://t/", "http://t/")]


def test_unseen_and_pull(spark):
    urls = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "source_id long, url string")
    raw = urls.filter("url <> 'c'").select("source_id", F.substring(F.sha2("url", 256), 1, 20).alias("external_id"), F.when(F.col("url") == "a", AS_OF - F.expr("interval 3 days")).otherwise(AS_OF - F.expr("interval 20 days")).alias("fetched_at"))
    assert rows_of(select.filter_unseen(urls, raw, as_of=AS_OF), "url") == [("b",), ("c",)]
    msgs = spark.range(1, 121).selectExpr("'c' channel", "id message_id")
    cur = spark.createDataFrame([("c", 10)], "channel string, last_message_id long")
    assert rows_of(select.delta_pull(msgs, cur).agg(F.min("message_id"), F.count("*"))) == [(71, 50)]
    assert rows_of(state.advance_cursors(cur, msgs.limit(5).union(spark.sql("select 'd', 4L")))) == [("c", 10), ("d", 4)]


# --- deduplication -----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_greedy_matches_loop(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    rows = [(1000 + i, i, f"u{rng.integers(25)}", f"t{rng.integers(25)}" if rng.random() < 0.8 else None) for i in range(n)]
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (25, 2)) if a < b]
    near = {frozenset(e) for e in edges}
    accepted, want = [], []
    for i, p, u, t in rows:
        url = [x for x in accepted if x[2] == u]
        title = [x for x in accepted if t is not None and x[3] == t]
        sem = [x for x in accepted if frozenset((x[1], p)) in near]
        basis = "url" if url else "title" if title else "semantic" if sem else None
        want.append((i, basis is None, basis))
        if basis is None:
            accepted.append((i, p, u, t))
    df = spark.createDataFrame(rows, "id long, position long, url_key string, title_key string").repartition(3)
    got = dedup.greedy(df, spark.createDataFrame(edges, "a long, b long"))
    assert rows_of(got, "id", "accepted", "basis") == sorted(want, key=str)


def test_greedy_follows_long_chains(spark):
    """A path of edges and one of alternating URL and title keys, a link a round: every second row is accepted."""
    n = 60
    rows = [(i, i, f"e{i}", None) for i in range(n)] + [(1000 + i, 1000 + i, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(n)]
    edges = [(i, i + 1) for i in range(n - 1)]
    got = dedup.greedy(spark.createDataFrame(rows, "id long, position long, url_key string, title_key string").coalesce(1), spark.createDataFrame(edges, "a long, b long").coalesce(1))
    assert rows_of(got, "id", "accepted") == sorted([(i, i % 2 == 0) for i, *_ in rows], key=str)
    assert got.filter("accepted = (basis is not null)").count() == 0


def test_dedup_gates(spark):
    old = spark.createDataFrame([(1, "Free Domain", "domain", NOW - dt.timedelta(days=10)), (2, "Free Domain", "domain", NOW - dt.timedelta(days=5)), (3, "Old title", "domain", NOW - dt.timedelta(days=100))], "id long, title string, category string, first_seen timestamp")
    prints = old.select(F.col("id").alias("offer_id"), O.sha256_hex(F.concat(F.lit("http://o/"), F.col("id").cast("string"))).alias("url_hash"), O.sha256_hex(F.lower("title")).alias("title_hash"), F.when(F.col("id") == 2, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array()).cast("array<float>").alias("embedding"))
    cand = spark.createDataFrame([(10, 0, "http://o/3", "x", "domain", []), (11, 1, "http://n/1", "FREE domain", "domain", []), (12, 2, "http://n/2", "free domain", "cloud", [0.0, 1.0]), (13, 3, "http://n/3", "old title", "domain", [1.0, 0.05]), (14, 4, "http://n/2", "y", "z", []), (15, 5, "http://n/5", "", "", [])], "id long, position long, canonical_url string, title string, category string, embedding array<float>")
    got = {r.id: r for r in dedup.dedup(cand, prints, old, as_of=AS_OF).collect()}
    assert {i: (r.is_dup, r.basis, r.existing_offer_id) for i, r in got.items()} == {10: (True, "url", 3), 11: (True, "title", 1), 12: (False, None, None), 13: (True, "semantic", 2), 14: (True, "url", 12), 15: (False, None, None)}
    assert got[13].similarity == pytest.approx(0.9988, abs=1e-4)


def test_semantic_pairs(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(150, 8)).astype(np.float32)
    v[10], v[20] = v[5] * 2, 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(150)] + [(200, []), (201, [1.0])]
    got = {(r.a, r.b) for r in dedup.semantic_pairs(spark.createDataFrame(rows, "id long, embedding array<float>"), threshold=0.8, block_rows=30).collect()}
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if u[i] @ u[j] >= 0.8}
    assert got == want and (5, 10) in got


# --- dispatch --------------------------------------------------------------------------------------------


def lane(spark):
    day = dt.timedelta(days=1)
    offers = [(i, i, f"Offer {i}", "cloud" if i % 2 else "notable_repo", "verified", i != 6, NOW - (20 - i) * day, "h", None) for i in range(1, 11)]
    o = spark.createDataFrame(offers, "id long, raw_item_id long, title string, category string, verification_status string, is_active boolean, first_seen timestamp, author_handle string, raw string")
    ago = lambda m: NOW - dt.timedelta(minutes=m)
    rows = [(101, 1, "sent", 1, None, ago(99)), (102, 3, "pending", 1, ago(5), ago(98)), (103, 5, "pending", 1, ago(16), ago(97)), (104, 7, "failed", 20, ago(50), ago(96)), (105, 9, "failed", 2, ago(50), ago(95))]
    d = spark.createDataFrame([(i, k, "discord", s, a, None, None, c, t if s == "sent" else None, t) for i, k, s, a, c, t in rows], "id long, offer_id long, channel string, status string, attempts int, last_error string, message_meta string, claimed_at timestamp, sent_at timestamp, created_at timestamp")
    return o, d


def test_claim(spark):
    o, d = lane(spark)
    after, claimed, top = dispatch.claim(o, d, channel="discord", limit=10, held=("notable_repo",), as_of=AS_OF)
    assert rows_of(claimed, "id", "attempts") == [(103, 2), (105, 3)] and rows_of(top, "id") == [(104,)]
    assert after.count() == 5
    _, few, _ = dispatch.claim(o, d, channel="discord", limit=2, held=("notable_repo",), as_of=AS_OF)
    assert rows_of(few, "id") == [(103,)]  # the leased row uses up a slot
    after, claimed, _ = dispatch.claim(o, d, channel="discord", limit=10, as_of=AS_OF)
    assert {r.offer_id for r in claimed.collect()} == {2, 4, 5, 8, 9, 10} and after.count() == 9
    _, one, _ = dispatch.claim(o, d, channel="email", limit=3, as_of=AS_OF)
    assert {r.offer_id for r in one.collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        dispatch.validate_channel("fax")
    assert dispatch.has_undispatched(o, d, channel="discord") and not dispatch.has_undispatched(o.filter("id = 1"), d, channel="discord")


def test_queue_and_preview(spark):
    o, d = lane(spark)
    raw = o.select(F.col("raw_item_id").alias("id"), F.lit(0).cast("long").alias("source_id"))
    sources = tables(spark)[1]
    assert {r.id for r in dispatch.dispatch_queue(o, raw, sources, d, channel="discord").collect()} == {2, 3, 4, 5, 7, 8, 9, 10}
    assert [r.id for r in dispatch.preview(o, raw, sources, d, channel="discord", limit=6).collect()] == [3, 5, 7, 9, 2, 4]


def test_daily_cap(spark):
    titles = ["alpha one", "alpha one two", "alpha one x1y", "alpha one zzz", "beta qqq", "gamma www", "delta eee"]
    o = spark.createDataFrame([(i, None, t, "notable_repo", "verified", True, NOW - dt.timedelta(days=30 - i), f"h{i if i > 3 else 0}", None) for i, t in enumerate(titles)], lane(spark)[0].schema)
    d = lane(spark)[1].limit(0)
    args = {"channel": "discord", "category": "notable_repo", "as_of": AS_OF}
    out = {r.id for r in dispatch.cap_exclusions(o, d, cap=3, **args).collect()}
    assert len(out) == 4 and len({0, 1, 2, 3} - out) <= 1
    assert dispatch.cap_exclusions(o, d, cap=8, **args).count() == 0
    assert dispatch.cap_exclusions(o, d, cap=3, held=("notable_repo",), **args).count() == 0
    assert dispatch.cap_exclusions(o, d, cap=0, **args).count() == 7


def test_render_and_outcomes(spark):
    raw = json.dumps({"promo_code": "SAVE", "base_url": None, "github_repo": "o/r", "exact_steps": [f"s{i}" for i in range(9)]})
    o = spark.createDataFrame([(1, "T" * 300, "https://u", None, "d", "llm_api_drop", "credit", 1500.0, "USD", None, json.dumps({"geography": ["US"], "steps": ["a", "b"]}), "@me", raw, "src", NOW), (2, "T", "https://u", "https://c", None, None, None, None, None, None, "[]", None, None, "src", NOW)], "id long, title string, url string, canonical_url string, description string, category string, offer_type string, value double, currency string, expires_at timestamp, requirements string, author_handle string, raw string, source_name string, first_seen timestamp")
    one, two = (json.loads(r.message) for r in dispatch.render_embeds(o, as_of=AS_OF).orderBy("id").collect())
    names = [f["name"] for f in one["fields"]]
    assert names == ["🎟 Promo Code", "📦 Repository", "🏷 Type", "💰 Value", "⏳ Expires", "✅ Requirements", "📋 How to claim"]
    assert len(one["title"]) == 256 and one["fields"][2]["value"] == "🔑 Llm Api Drop · Credit" and one["fields"][5]["value"] == "US • a • b" and one["fields"][6]["value"].count("\n") == 5 and one["author"] == {"name": "@me"}
    assert [f["value"] for f in two["fields"]] == ["✨ Other · Other", "—", "No expiration"] and two["url"] == "https://c" and "author" not in two
    routes = spark.createDataFrame([("cloud", "c"), ("llm", "")], "category string, route string")
    assert rows_of(dispatch.route(spark.createDataFrame([("cloud",), ("llm",), ("x",)], "category string"), routes, default="d"), "route") == [("c",), ("d",), ("d",)]
    d = lane(spark)[1]
    res = spark.createDataFrame([(102, "sent", None, None), (105, "failed", "boom", '{"a":1}')], "id long, status string, error string, meta string")
    got = {r.id: r for r in state.apply_outcomes(d, res, as_of=AS_OF).collect()}
    assert (got[102].status, got[102].sent_at, got[102].attempts, got[102].message_meta) == ("sent", NOW, 1, "{}") and (got[105].last_error, got[105].sent_at) == ("boom", None) and got[104].status == "failed"


# --- state, reports, streams ----------------------------------------------------------------------------------


def test_diversify_matches_the_loop(spark):
    rng = np.random.default_rng(5)
    data = [("ab"[i % 2], f"{i:03}", sorted({f"t{x}" for x in rng.integers(0, 25, rng.integers(0, 6))})) for i in range(60)]
    data += [("c", "900", ["x"])]
    df = spark.createDataFrame(data, "lane string, position string, tags array<string>").repartition(4)
    want = []
    for name in "abc":
        left, seen = sorted((p, t) for n, p, t in data if n == name), set()
        for _ in range(min(6, len(left))):
            best = max(left, key=lambda x: (len(set(x[1]) - seen), -int(x[0])))
            seen |= set(best[1])
            left.remove(best)
            want.append((name, best[0]))
    assert rows_of(dispatch.diversify(df, k=6, lane_col="lane"), "lane", "position") == sorted(want)
    assert dispatch.diversify(df.limit(0), k=6, lane_col="lane").count() == 0


def test_signal_words_lose_no_match(spark):
    """The plain search before each pattern never hides a match."""
    from tidewheel.functions import fixed_values as V
    from tidewheel.functions import signals as S

    texts = ["Base_URL = https://x.y", "api-key: " + "a" * 22, "try Venice.ai", "deepseek v3", "Qwen 2", "free llm access", "FREE api  credits", "$5 in free tokens", "register to get free", "openai-compatible API is free", "no credit card needed", "unlimited requests per day", "daily reset is free",
             "lifetime license", "100 % off", "one year premium", "AppSumo", "promo: ABC", "coupon code XYZ1", "use code AB12", "10% off with", "1 year free", "heygen trick", "invite code: ABCD", "use coupon ABCD", "code : Abcd", "open-source alternative to", "replaces Notion", "github.com/a/b released", "show hn", "today open sourced",
             "https://github.com/a/b", "x.edu.pk", "NY IP", "free google ai pro", "gemini free", "google one ai", "github student", "jetbrains student", "figma for education", "student pack", "nothing", None]
    plain = F.lit(None).cast("string")
    for name, pattern in reversed(V.SIGNALS):
        plain = F.when(F.col("t").rlike(pattern), name).otherwise(plain)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.classify_signal(F.col("t")).alias("a"), plain.alias("b"), S.promo_code_present(F.col("t")).alias("p"), F.col("t").rlike(V.PROMO_CODE).alias("q")).collect()
    assert all(r.a == r.b and r.p == r.q for r in rows) and sum(r.a is not None for r in rows) == len(texts) - 2


def test_upserts(spark):
    raw = tables(spark, 3)[0].withColumn("attempts", F.lit(2))
    new = spark.createDataFrame([(1, "1", "p", 1), (1, "1", "q", 2), (9, "x", "r", 1)], "source_id long, external_id string, raw_payload string, seq int")
    got = {(r.source_id, r.external_id): r for r in state.upsert_raw_items(raw, new, as_of=AS_OF).collect()}
    assert len(got) == 4 and (got[1, "1"].raw_payload, got[1, "1"].attempts, got[1, "1"].fetched_at, got[1, "1"].id) == ("q", 2, NOW, 1) and (got[9, "x"].attempts, got[9, "x"].permanently_rejected) == (0, False)
    names = spark.createDataFrame([("a", 1)], "name string, v int")
    assert rows_of(state.insert_ignore(names, spark.createDataFrame([("a", 9), ("b", 2), ("b", 2)], "name string, v int"), ["name"])) == [("a", 1), ("b", 2)]
    ch = spark.createDataFrame([(1, "u", "new"), (2, "v", "rejected")], "id long, channel_username string, status string")
    assert rows_of(state.approve(ch, spark.createDataFrame([(1,), (2,)], "id long")), "status") == [("approved",), ("rejected",)]
    assert [r.id for r in state.list_channels(ch).collect()] == [2, 1] and state.register_channels(ch, spark.createDataFrame([(3, "u"), (4, "w")], "id long, channel_username string")).count() == 3


def test_attempts(spark):
    raw = tables(spark, 4)[0]
    log = spark.createDataFrame([(1, NOW, 1, "a", True), (1, NOW, 2, "b", False), (2, NOW, 1, "x", False), (2, NOW, 2, "x", False), (2, NOW, 3, "y", False), (3, NOW, 1, "z", True)], "raw_item_id long, ts timestamp, seq int, reason string, permanent boolean")
    assert rows_of(state.fold_attempts(raw, log), "id", "attempts", "permanently_rejected", "last_reject_reason") == [(1, 2, False, "b"), (2, 3, True, "y"), (3, 1, True, "z"), (4, 0, False, None)]


def test_reports_on_empty_tables(spark):
    raw, sources, offers = tables(spark)
    o, d = lane(spark)
    e = o.limit(0)
    assert report.totals(e).first() == (0, 0) and report.funnel(raw.limit(0), e).count() == 0 and report.send_latency(e, d.limit(0)).first().n == 0
    assert report.overview(e, d.limit(0)).first() == (0, 0, 0) and [r.n for r in report.daily_counts(e, as_of=AS_OF).collect()] == [0] * 7
    assert report.zero_yield(report.yield_per_source(raw, e, sources)).count() == 3
    runs = spark.createDataFrame([(1, NOW, None, "success"), (2, NOW - dt.timedelta(1), NOW + dt.timedelta(1), "success"), (3, NOW, NOW, "error")], "id long, started_at timestamp, finished_at timestamp, status string")
    assert report.last_success(runs).first().run_id == 2 and report.last_run(runs).first().id == 3 and report.recent_runs(runs).count() == 3 and report.last_success(runs.limit(0)).first().run_id is None


def test_offers_feed(spark):
    raw, sources, _ = tables(spark)
    o = lane(spark)[0].withColumn("expires_at", F.when(F.col("id") == 10, AS_OF - F.expr("interval 1 day")).cast("timestamp"))
    feed = lambda **k: [r.id for r in select.offers_feed(o, raw, sources, as_of=AS_OF, **k).orderBy(F.desc("id")).collect()]
    assert feed(q="offer 1") == [10, 1] and feed(availability="expired") == [10, 6] and len(feed(availability="all")) == 10 and feed(category="cloud", limit=2) == [9, 7]


def test_streams(spark, tmp_path):
    src, n = f"{tmp_path}/src", 30
    events = spark.range(n).selectExpr("id % 4 AS source_id", "timestamp'2026-01-01' + make_dt_interval(0, cast(id * 5 as int)) AS ts", "id AS seq", "id % 3 = 0 AS ok", "concat('e', id) AS error")
    for part in range(3):
        events.filter(f"seq div 10 = {part}").coalesce(1).write.mode("append").parquet(src)
    stream = jobs.read(spark, src, events.schema, files_per_batch=1)
    got = jobs.drained(jobs.source_health(stream), "health_t", mode="update", keys=["source_id"])
    assert rows_of(got) == rows_of(state.fold_health(events))
    days = jobs.drained(jobs.daily_counts(jobs.read(spark, src, events.schema, files_per_batch=1), time_col="ts"), "days_t", mode="complete")
    assert rows_of(days) == rows_of(events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")))
    once = jobs.drained(jobs.suppress_repeats(jobs.read(spark, src, events.schema, files_per_batch=1), keys=["source_id"], time_col="ts", within="1000 days").select("source_id"), "once_t", mode="append")
    assert rows_of(once) == [(0,), (1,), (2,), (3,)]
    tries = jobs.read(spark, src, events.schema, files_per_batch=1).selectExpr("source_id AS raw_item_id", "ts", "seq", "seq = 29 AS permanent", "error AS reason")
    got = jobs.drained(jobs.retry_counts(tries, max_attempts=8), "retry_t", mode="update", keys=["raw_item_id"])
    assert rows_of(got.drop("reasons")) == [(0, 8, True, "e28"), (1, 8, True, "e29"), (2, 7, False, "e26"), (3, 7, False, "e27")]
    raw_schema = tables(spark)[0].schema
    items = spark.range(20).selectExpr("id % 2 AS source_id", "cast(id % 5 as string) AS external_id", "concat('p', id) AS raw_payload", "id AS seq")
    items.write.parquet(f"{tmp_path}/items")
    table = jobs.Table(spark, f"{tmp_path}/raw", raw_schema, keys=["source_id", "external_id"], parts=4)
    jobs.ingest(spark, f"{tmp_path}/items", table, f"{tmp_path}/cp1", schema=items.schema, available_now=True).awaitTermination()
    assert rows_of(table.read(), "source_id", "external_id", "raw_payload") == rows_of(items.groupBy("source_id", "external_id").agg(F.max_by("raw_payload", "seq")))
    before = table._newest(None)
    spark.createDataFrame([(0, "4", "new", 99)], items.schema).write.mode("append").parquet(f"{tmp_path}/items")
    jobs.ingest(spark, f"{tmp_path}/items", table, f"{tmp_path}/cp1", schema=items.schema, available_now=True).awaitTermination()
    assert sum(v != before[p] for p, v in table._newest(None).items()) == 1  # one part is written anew
    assert table.read().count() == 10 and rows_of(table.read().filter("source_id = 0 and external_id = '4'"), "raw_payload") == [("new",)]
    msgs = spark.range(1, 31).selectExpr("concat('c', id % 2) AS channel", "id AS message_id")
    msgs.write.parquet(f"{tmp_path}/msgs")
    cursors = jobs.Table(spark, f"{tmp_path}/cursors", "channel string, last_message_id long", keys=["channel"])
    start = spark.createDataFrame([("c1", 9)], "channel string, last_message_id long")
    cursors.replace(lambda old: start, start, -1)
    jobs.pull(spark, f"{tmp_path}/msgs", f"{tmp_path}/out", cursors, f"{tmp_path}/cp2", schema=msgs.schema, available_now=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 25 and rows_of(cursors.read()) == [("c0", 30), ("c1", 29)]


@pytest.mark.parametrize("parts", [1, 7])
def test_partition_counts_do_not_matter(spark, parts):
    raw, sources, offers = tables(spark)
    got = select.fetch_unprocessed(raw.repartition(parts), sources, offers, limit=9)
    assert {r.id for r in got.collect()} == {1, 4, 6, 7, 34, 36, 37, 39, 40}


def test_title_search(spark):
    """As a plain search, for short, odd and missing words; few postings are read for rare ones."""
    from tidewheel.operators import search

    titles = [None, "", "ab", "Free GPU credits", "free gpu", "GPU free", "100% off_now", "100 percent", "Straße frei", "aaaa", "aaa"]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    postings = search.trigram_postings(rows).persist()
    for q in ("free gpu", "FREE", "ab", "", "0% o", "_", "straße", "aaaa", "aaa", "zzz", "gpu credits"):
        got = {r.id for r in search.search_titles(rows, postings, q).collect()}
        assert got == {i for i, t in enumerate(titles) if t is not None and q.lower() in t.lower()}, q
    assert search.candidates(postings, "aaaa").count() == 2 and search.candidates(postings, "gpu credits").count() == 1
