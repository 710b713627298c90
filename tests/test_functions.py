"""Column functions against known pairs and plain Python."""

import html
import re
from urllib.parse import parse_qsl, urlencode

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import fixed_values as V
from tidewheel.functions import offers as O
from tidewheel.functions import signals as S
from tidewheel.functions import text as X
from tidewheel.functions import urls as U


def apply(spark, f, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v")).alias("o")).collect())]


CLEAN = [
    ("HTTPS://Example.COM/Path?utm_source=x&utm_medium=y&fbclid=1&page=2", "https://example.com/Path?page=2"),
    ("http://www.example.com/a/#section", "http://example.com/a"),
    ("https://example.com/?id=42&ref=abc", "https://example.com/?id=42"),
    ("http://example.com:80/AWS", "http://example.com/AWS"),
    ("http://example.com:8080/a", "http://example.com:8080/a"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com//", "https://example.com"),
    ("https://example.com:port/", "error"),
    ("https://user:pw@example.com/x", "https://example.com/x"),
    ("https://example.com/?a=&b=1&B=%zz", "https://example.com/?b=1&B=%25zz"),
    ("https://example.com/?q=a~b*c d+e", "https://example.com/?q=a~b%2Ac+d+e"),
    (None, None),
]


def test_clean_url(spark):
    assert apply(spark, U.clean_url, [u for u, _ in CLEAN]) == [w for _, w in CLEAN]


def test_clean_query_is_form_encoding(spark):
    values = ["a=1&b=2", "x=%C3%A9&y=a%2Bb", "k=v&k=w", "a=b=c", "n", "", "sp=a+b", "emoji=%F0%9F%98%80", "q=~*-_.!'()"]
    want = [urlencode([(k, v) for k, v in parse_qsl(x) if k.lower() not in V.TRACKING_PARAMS]) for x in values]
    assert apply(spark, U.clean_query, values) == want


def test_extract_urls(spark):
    got = apply(spark, lambda c: U.extract_urls(c, F.array(F.lit("http://extra/"), F.lit(""), F.lit(None))), ["go http://a.b/c. and (https://d.e/f) http://a.b/c!", None])
    assert got == [["http://a.b/c", "https://d.e/f", "http://extra/"], ["http://extra/"]]


def test_url_flags(spark):
    limit = "http://h/" + "a" * (300 - 9)
    assert apply(spark, U.is_junk_url, [limit, limit + "a", "http://h" + "/x" * 10, "http://h" + "/x" * 11]) == [False, True, False, True]
    assert apply(spark, U.is_noise_url, ["https://www.youtube.com/x", "https://wwx.com", "https://ww.x.com/1", "https://good.io/t.me"]) == [True, True, True, False]


def test_clean_text(spark):
    raw = [
        "🔥🔥🔥 GREAT DEAL!!! Like and share @some_bot https://t.me/promo now", "<p>Get a <a href='http://x'>free VPS</a> today</p><script>bad()</script>", "x" * 5000, None, "a &amp; b", "# Head\n**bold** [link](http://a) ![i](u)\n\n\n\nnext  line",
        "café @café_bot end", "one two", "tail #a #b-c ",
    ]
    got = apply(spark, lambda c: X.clean_text(c, 100), raw)
    assert "🔥🔥" not in got[0] and "!!" not in got[0] and "@" not in got[0] and "t.me" not in got[0] and "share" not in got[0].lower()
    assert got[1] == "Get a free VPS today"
    assert got[2:6] == ["x" * 100, "", "a & b", "Head\nbold link\nnext line"]
    assert got[6:] == ["café end", "one\ntwo", "tail"]


def test_html_parts(spark):
    got = apply(spark, X.html_parts, ["<a href='https://a/'>x</a><a href='/r'>y</a><style>p{}</style> z &lt;", None])
    assert (got[0].text, got[0].hrefs) == ("x y z <", ["https://a/"]) and got[1].text is None


def test_titles(spark):
    pairs = [("FREE CREDITS FOR ALL STUDENTS!!!", "Free credits for all students!"), ("🎉 1. [Big Deal] Here", "Big Deal] Here"), ("lower start", "Lower start"), ("12345", ""), (None, ""), ("AWS", "AWS"), ("é été", "É été")]
    assert apply(spark, X.normalize_title, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_prefilter(spark):
    text = "A solid library that does many useful things"
    rows = [(text, False, "prefilter:no_deal_signal"), (text, True, ""), ("tiny", True, "prefilter:too_short"), (text + " page has been removed", True, "prefilter:junk_body"), ("404 not here but long enough", False, "prefilter:junk_title"), ("Sign in to get started with free credits", False, "prefilter:junk_title"), ("Get free credits for your project", False, ""), (None, False, "prefilter:too_short")]
    df = spark.createDataFrame(rows, "t string, r boolean, w string")
    assert df.filter(X.prefilter_reason(F.col("t"), F.col("r")) != F.col("w")).count() == 0


def test_small_text_functions(spark):
    assert apply(spark, lambda c: X.estimate_tokens(c, 0), ["x" * 40, ""]) == [10, 0] and apply(spark, X.estimate_tokens, [""]) == [512]
    assert apply(spark, lambda c: X.truncate(c, 5), [" abcde ", "abcd efgh", None]) == ["abcde", "abcd…", None]
    words = ["free-resources and più", "it's o'neil 3d PRINT", ""]
    assert apply(spark, X.python_title, words) == [w.title() for w in words]
    fenced = apply(spark, X.fence, [f"a {V.FENCE_CLOSE.lower()} b", None])
    assert fenced == [f"{V.FENCE_OPEN}\na  b\n{V.FENCE_CLOSE}", f"{V.FENCE_OPEN}\n(no text)\n{V.FENCE_CLOSE}"]
    assert apply(spark, X.unescape, ["&eacute;&#33;", None]) == [html.unescape("&eacute;&#33;"), None]
    df = spark.createDataFrame([(1234.5, "USD"), (None, "USD"), (2.0, None)], "v double, c string")
    assert [tuple(r) for r in df.select(X.format_value("v" and F.col("v"), F.col("c")), X.format_value_trailing(F.col("v"), F.col("c"))).collect()] == [("USD 1,234", "1,234.5 USD"), ("—", "—"), ("2", "2")]


def test_time_labels(spark):
    now = "timestamp'2026-01-10 00:00:00'"
    rows = spark.sql(f"select * from values (timestamp'2026-01-10 00:30:00'), (timestamp'2026-01-10 05:00:00'), (timestamp'2026-01-13 12:00:00'), (timestamp'2026-01-08 12:00:00'), (null) as t(e)")
    e, n = F.col("e"), F.expr(now)
    got = [tuple(r) for r in rows.select(X.humanize_expiry(e, n), X.expires_in(e, n)["label"], X.expires_in(e, n)["state"], X.time_ago(e, n)).collect()]
    assert got == [("⏰ 30m left", "in 1 day", "soon", "0s ago"), ("⏰ 5h left", "in 1 day", "soon", "0s ago"), ("⏰ In 3d", "in 4 days", "ok", "0s ago"), ("⚠️ Expired 2d ago", "expired 2d ago", "expired", "1d ago"), ("No expiration", "no expiry", "none", "—")]


SIGNAL_CASES = [
    ("base url = https://x.y and more", "llm_api_drop"), ("no credit card required today", "llm_api_drop"), ("lifetime deal inside", "saas_deal"), ("use code SAVE20", "coupon"), ("promo code: ABCD12", "coupon"), ("see https://github.com/a/b", "open_source_repo"),
    ("https://github.com/login/x", None), ("github student offers", "student_pack"), ("nothing here", None),
]


def test_signals(spark):
    assert apply(spark, S.classify_signal, [a for a, _ in SIGNAL_CASES]) == [b for _, b in SIGNAL_CASES]
    assert apply(spark, S.extract_github_repos, ["https://github.com/a/b x https://github.com/topics/y http://github.com/c.d/e-f"]) == [["https://github.com/a/b", "http://github.com/c.d/e-f"]]
    assert apply(spark, S.promo_code, ["coupon code: AB12CD", "none"]) == ["AB12CD", None]
    df = spark.createDataFrame([("https://github.com/Org/x", "h", "org"), ("Own/name", "h", "own"), (None, " Ha ", "ha"), ("", None, "")], "r string, h string, w string")
    assert df.filter(S.repo_org(F.col("r"), F.col("h")) != F.col("w")).count() == 0
    tags = apply(spark, lambda c: S.diversity_tags(c, F.lit("o/n"), F.lit(None)), ["The Fast agent-harness for a DB"])
    assert tags == [["org:o", "agent", "harness"]]


def test_taxonomy(spark):
    assert apply(spark, O.coerce_category, ["  CLOUD ", "Saas_Deal", "nonsense", None, ""]) == ["cloud", "saas_deal", "other", "other", "other"]
    assert apply(spark, O.coerce_offer_type, ["CREDIT", " giveaway ", "bogus", None]) == ["credit", "giveaway", "other", "other"]
    rows = O.taxonomy(spark).select("key", O.hex_color(F.col("color")).alias("c")).collect()
    assert len({r.key for r in rows}) == 16 and rows[0].c == "#0EA5E9"
    assert apply(spark, O.is_valid_category, ["llm", "x", None]) == [True, False, False]


REPLIES = [
    ('{"is_offer": true, "title": "Free AWS credits", "url": "https://aws.x/", "category": "CLOUD", "currency": "usd", "value": "100", "expires_at": "2026-12-31T00:00:00Z"}', []),
    ('```json\n{"is_offer": true, "title": "GET FREE CREDITS NOW!!", "url": "https://aws.x/"}\n```', []),
    ('{"is_offer": false, "title": "Free AWS credits", "url": "https://aws.x/"}', ["not_offer"]),
    ('{"is_offer": true, "title": "ab", "url": "https://aws.x/"}', ["title"]),
    ('{"is_offer": true, "title": "12345", "url": "https://aws.x/"}', ["title"]),
    ('{"is_offer": true, "title": "Fine title", "url": "x", "confidence": 1.5, "value": -5, "currency": "euros"}', ["url", "value", "currency", "confidence"]),
    ('{"is_offer": true, "title": "Fine title", "url": "https://aws.x/", "confidence": -0.1, "expires_at": "soon"}', ["expires_at", "confidence"]),
    ("no json", None),
]


def test_validate_offers(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    rows = sorted(O.validate_offers(df, "reply").collect())
    for row, (_, want) in zip(rows, REPLIES):
        if want is None:
            assert row.reject_reasons and row.offer is None
        else:
            assert row.reject_reasons == want and (row.offer is None) == bool(want)
    first, second = rows[0].offer, rows[1].offer
    assert (first.category, first.currency, first.value, first.expires_at.year, first.is_evergreen, first.exact_steps) == ("cloud", "USD", 100.0, 2026, False, [])
    assert (second.title, second.category, second.confidence) == ("Get free credits now!", "other", 0.5)


def test_liveness(spark):
    rows = [(200, "text/html", "x EXPIRED y", None, "soft_dead"), (200, "application/json", "expired", None, "live"), (204, None, None, None, "live"), (403, None, None, None, "live"), (410, None, None, None, "dead"), (503, None, None, None, "unreachable"), (302, None, None, None, "soft_dead"), (None, None, None, "boom", "unreachable"), (200, "text/html", "y" * 4000 + "expired", None, "live")]
    df = spark.createDataFrame(rows, "s int, c string, b string, e string, w string")
    assert df.filter(O.classify_liveness(F.col("s"), F.col("c"), F.col("b"), F.col("e")) != F.col("w")).count() == 0
    df = spark.createDataFrame([(0.8, "live", 0.84), (0.99, "live", 1.0), (0.5, "unreachable", 0.35), (0.5, "dead", 0.5)], "c double, l string, w double")
    assert df.filter(O.adjust_confidence(F.col("c"), F.col("l")) != F.col("w")).count() == 0


@pytest.mark.parametrize("a, b, want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(O.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_patterns_are_java_and_python():
    for _, p in V.SIGNALS:
        re.compile(p)


def test_category_prompts(spark):
    df = spark.createDataFrame([(1, "llm", "models"), (0, "cloud", "credits"), (2, "a_rather_long_key", "x")], "position int, key string, description string")
    assert O.category_prompt_block(df).first().block == "cloud           — credits\nllm             — models\na_rather_long_key — x"
    block = O.category_prompt_block(O.taxonomy(spark)).first().block.split("\n")
    assert len(block) == 16 and block[0].startswith("cloud           — AWS/GCP") and block[-1] == "other           — Anything that doesn't fit above"
    assert O.category_prompt_csv(df).first().keys == "cloud, llm, a_rather_long_key"
    block = O.category_prompt_block(O.taxonomy(spark)).first().block.split("\n")
    assert len(block) == 16 and block[0].startswith("cloud           — AWS/GCP") and block[-1] == "other           — Anything that doesn't fit above"
    assert O.category_prompt_csv(O.taxonomy(spark)).first().keys.startswith("cloud, llm, llm_api_drop, hosting")
    assert [tuple(r) for r in O.taxonomy_differences(df, df.filter("key <> 'llm'")).collect()] == [("llm", "left")]
