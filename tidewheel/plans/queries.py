"""Queries over the given tables, one or more for each family of operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import offers as O
from ..functions import signals as S
from ..functions import text as X
from ..functions import urls as U
from ..operators import dedup, dispatch, extract, report, select, state
from ..sources import captures, feeds
from ..streaming import jobs, messages
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL after the shared views."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = T.VIEWS + sql
        return f

    return add


def _re2(pattern: str) -> str:
    """A fixed pattern as SQL text for an engine without look-ahead and inline (?U:...)."""
    return pattern.replace("(?!(?:login|signup|explore|topics|trending|features|marketplace|pricing))", "").replace("'", "''")


# --- text and URL functions -------------------------------------------------------------

_STRIP = r"regexp_replace({0}, '^[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"


def _reason_sql(text: str) -> str:
    t = _STRIP.format(f"coalesce({text}, '')")
    first = _STRIP.format(f"regexp_extract({t}, '^([^\\n\\r]*)', 1)")
    return f"CASE WHEN length({t}) < 24 THEN 'prefilter:too_short' WHEN regexp_matches({first}, '{_re2(V.JUNK_TITLE)}') THEN 'prefilter:junk_title' WHEN regexp_matches({t}, '{_re2(V.JUNK_BODY)}') THEN 'prefilter:junk_body' WHEN NOT regexp_matches({t}, '{_re2(V.DEAL_SIGNAL)}') THEN 'prefilter:no_deal_signal' ELSE '' END"


_PARAMS = ", ".join(f"'{p}'" for p in V.TRACKING_PARAMS)
_PREFIX = " OR ".join(f"starts_with(lower(split_part(p, '=', 1)), '{p}')" for p in V.TRACKING_PREFIXES)


def _clean_sql(url: str) -> str:
    """For URLs of plain hosts and unescaped parameters, as the pages have them."""
    kept = f"array_to_string(list_filter(string_split(regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p LIKE '%=_%' AND NOT (lower(split_part(p, '=', 1)) IN ({_PARAMS}) OR {_PREFIX})), '&')"
    path = f"regexp_extract({url}, '^[^:]*://[^/?#]*([^?#]*)', 1)"
    path = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/+$', '') END"
    return f"lower(regexp_extract({url}, '^([^:]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract({url}, '^[^:]*://([^/?#]*)', 1)), '^www[.]', '') || {path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


@query(f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN reason <> '' THEN reason WHEN row_number() OVER (PARTITION BY reason, clean ORDER BY doc_id) > 1 THEN 'dup:url' ELSE 'candidate' END AS outcome
FROM (SELECT doc_id, {_reason_sql('text')} AS reason, {_clean_sql('url')} AS clean FROM posts)) GROUP BY outcome""")
def post_outcomes(spark, sf_dir):
    """Posts through normalising, prefilter and URL gate, counted by outcome. Only keys and reasons are shuffled."""
    reason = X.prefilter_reason(F.col("text"), F.lit(False)).alias("reason")
    rows = T.posts(spark, sf_dir, reason).select(U.clean_url(F.col("url")).alias("clean"), "reason")
    kept = F.col("reason") == ""
    groups = rows.groupBy("reason", F.when(kept, F.col("clean")).alias("clean")).agg(F.count("*").alias("n"))
    first = F.when(kept, "candidate").otherwise(F.col("reason"))
    parts = F.array(F.struct(first.alias("outcome"), F.when(kept, 1).otherwise(F.col("n")).alias("n")), F.struct(F.lit("dup:url").alias("outcome"), F.when(kept, F.col("n") - 1).otherwise(0).alias("n")))
    return groups.select(F.explode(parts).alias("x")).groupBy("x.outcome").agg(F.sum("x.n").alias("n")).filter("n > 0")


@query(f"SELECT page_id, {_clean_sql('url')} AS clean_url FROM pages")
def clean_urls(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", U.clean_url(F.col("url")).alias("clean_url"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), '^[w.]+', '') IN (" + ", ".join(f"'{h}'" for h in V.NOISE_HOSTS) + ") AS noise, length(url) > 300 OR length(url) - length(replace(url, '/', '')) > 12 AS junk FROM pages")
def url_flags(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", U.is_noise_url(F.col("url")).alias("noise"), U.is_junk_url(F.col("url")).alias("junk"))


@query("SELECT min(length(url)) AS min_len, median(length(url)) AS median_len, max(length(url)) AS max_len, min(s) AS min_slashes, median(s) AS median_slashes, max(s) AS max_slashes FROM (SELECT url, length(url) - length(replace(url, '/', '')) AS s FROM pages)")
def url_profile(spark, sf_dir):
    return report.url_profile(T.table(spark, sf_dir, "pages"))


@query(f"SELECT doc_id, {_reason_sql('text')} AS reason FROM documents")
def prefilter_outcomes(spark, sf_dir):
    return T.spread(T.table(spark, sf_dir, "documents")).select("doc_id", X.prefilter_reason(F.col("text"), F.lit(False)).alias("reason"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{_re2(p)}') THEN '{n}'" for n, p in V.SIGNALS) + " END AS signal, regexp_matches(lower(text), '" + "|".join(V.DEAL_HINTS) + f"') AS hint, regexp_matches(text, '{_re2(V.PROMO_CODE)}') AS promo FROM documents")
def classify_signals(spark, sf_dir):
    t, low = F.col("text"), F.col("low")
    docs = T.spread(T.table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("low", F.lower("text"))
    return docs.select("doc_id", S.classify_signal(t, low).alias("signal"), S.has_deal_hint(t, low).alias("hint"), S.promo_code_present(t, low).alias("promo"))


_WHITE = r"\s\x0B\x{85}\p{Z}"
_TITLE_SQL = (
    rf"""SELECT doc_id, {_STRIP.format(r"left(CASE WHEN regexp_matches(t, '^\p{Ll}') THEN upper(left(t, 1)) || substr(t, 2) ELSE t END, 200)")} AS title FROM (
SELECT doc_id, {_STRIP.format("regexp_replace(CASE WHEN letters >= 8 AND capitals / letters > 0.7 THEN lower(t) ELSE t END, '[WHITE]+', ' ', 'g')")} AS t FROM (
SELECT *, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS capitals FROM (
SELECT doc_id, array_to_string(list_filter(c, lambda x, i: NOT (i > 1 AND x = c[i - 1] AND regexp_matches(x, '[{V.EMOJI}!?]'))), '') AS t FROM (
SELECT doc_id, regexp_extract_all(regexp_replace(t, '^[WHITE{V.EMOJI}|•·—–\-:\[(\p{{Nd}}.)]+', ''), '(?s).') AS c FROM (
SELECT doc_id, {_STRIP.format("split_part(coalesce(text, ''), chr(10), 1)")} AS t FROM documents)))))"""
).replace("WHITE", _WHITE)


@query(_TITLE_SQL)
def normalized_titles(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.normalize_title(F.split("text", "\n")[0]).alias("title"))


@query("SELECT doc_id, CAST(length(coalesce(text, '')) // 4 + 512 AS bigint) AS tokens, CAST(length(coalesce(text, '')) // 4 AS bigint) AS bare FROM documents")
def token_estimates(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"), X.estimate_tokens(F.col("text"), 0).alias("bare"))


@query()
def clean_texts(spark, sf_dir):
    """Whole pages as clean text (no SQL: HTML parsing and back-references)."""
    return T.spread(T.table(spark, sf_dir, "pages")).select("page_id", X.clean_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, CAST(pos AS int) AS pos, href FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM (
SELECT page_id, list_transform(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<a [^>]*href="([^"]*)"', 1), lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) AS l FROM pages))""")
def page_links(spark, sf_dir):
    """All links of whole pages, relative ones too."""
    return T.spread(T.table(spark, sf_dir, "pages")).select("page_id", F.posexplode(X.html_links(F.col("html"))).alias("pos", "href"))


@query(r"SELECT doc_id, pos - 1 AS pos, url FROM (SELECT doc_id, unnest(l) AS url, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, [first_value] || [url] AS l FROM (SELECT doc_id, url, 'http://x.y/' || doc_id AS first_value FROM posts)))")
def extracted_urls(spark, sf_dir):
    """URLs of a post's text, then the lent one."""
    text = F.concat(F.lit("see http://x.y/"), F.col("doc_id").cast("string"), F.lit("; and again http://x.y/"), F.col("doc_id").cast("string"), F.lit("."))
    return T.posts(spark, sf_dir).select("doc_id", F.posexplode(U.extract_urls(text, F.array("url"))).alias("pos", "url"))


# --- feeds --------------------------------------------------------------------------------


@query(r"SELECT conv_id || '' AS channel, turn AS message_id, CAST(turn AS varchar) AS external_id, coalesce(text, '') AS text, len(list_distinct(regexp_extract_all(coalesce(text, ''), 'https?://\S+'))) AS n_urls FROM conversations WHERE coalesce(text, '') <> '' AND turn IS NOT NULL")
def channel_messages(spark, sf_dir):
    return feeds.message_payloads(T.messages(spark, sf_dir)).select("channel", "message_id", "external_id", "text", F.size("urls").alias("n_urls"))


@query("SELECT left(sha256(url), 16) AS external_id, 'Doc ' || doc_id || chr(10) || left(text, 500) AS text, url FROM posts WHERE starts_with(url, 'http')")
def search_results(spark, sf_dir):
    rows = T.posts(spark, sf_dir).select("url", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("snippet"), F.lit("q").alias("query"), F.lit("t").alias("category_tag"))
    return feeds.search_payloads(rows).select("external_id", "text", F.col("urls")[0].alias("url"))


@query()
def message_pages(spark, sf_dir):
    """Web pages read as channel pages (no SQL: HTML parsing)."""
    html = F.regexp_replace(F.col("html"), "<p>", '<div class="tgme_widget_message_text">')
    html = F.regexp_replace(html, "</p>", "</div>")
    pages = T.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("channel"), html.alias("html"))
    return captures.webview_payloads(pages, as_of=T.as_of()).select("external_id", "text", F.size("urls").alias("n_urls"))


# --- selection -----------------------------------------------------------------------------

_POOL = "pool AS (SELECT s.*, x.name FROM state s JOIN sources x ON x.id = source_id WHERE enabled AND NOT permanently_rejected AND NOT has_offer)"


@query(f", {_POOL} SELECT id FROM (SELECT id FROM pool ORDER BY fetched_at, id LIMIT 15) UNION SELECT id FROM (SELECT id FROM pool ORDER BY fetched_at DESC, id DESC LIMIT 45)")
def fetch_fair(spark, sf_dir):
    return select.fetch_unprocessed(T.raw_items(spark, sf_dir), T.sources(spark, sf_dir), T.offers(spark, sf_dir), limit=60, oldest_fraction=0.25).select("id")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25")
def per_source_cap(spark, sf_dir):
    return select.cap_per_group(T.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", per_group=25)


@query(", seen AS (SELECT source, url, count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 20 < 14) AS n FROM posts GROUP BY source, url) SELECT p.doc_id FROM posts p JOIN seen s ON s.source = p.source AND s.url = p.url WHERE s.n = 0")
def unseen_pages(spark, sf_dir):
    """Pages that their source has not brought in the last 14 days."""
    posts = T.posts(spark, sf_dir).select("doc_id", F.col("source").alias("source_id"), "url")
    old = posts.filter("doc_id % 3 = 0").select("source_id", F.substring(F.sha2("url", 256), 1, 20).alias("external_id"), (T.as_of() - F.make_interval(days=(F.col("doc_id") % 20).cast("int"))).alias("fetched_at"))
    return select.filter_unseen(posts, old, within_days=14, as_of=T.as_of()).select("doc_id")


@query("SELECT mode, batch, count(*) AS posts, sum(length(least_text)) AS chars FROM (SELECT mode, (n - 1) // 10 AS batch, left(text, 2000) AS least_text FROM (SELECT text, CASE WHEN doc_id % 4 = 0 THEN 'repo' ELSE 'deal' END AS mode, row_number() OVER (PARTITION BY doc_id % 4 = 0 ORDER BY doc_id) AS n FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 200))) GROUP BY ALL")
def model_batches(spark, sf_dir):
    """A pick of 200 posts (the feature: one run's batch) as numbered prompts of ten."""
    picked = T.table(spark, sf_dir, "documents").orderBy("doc_id").limit(200).select("doc_id", "text", F.array(F.lit("http://a.b/")).alias("urls"), F.when(F.col("doc_id") % 4 == 0, "repo").otherwise("deal").alias("mode"))
    prompts = extract.batch_prompts(select.batches(picked, mode="mode", order="doc_id"))
    frame = len("URLs: http://a.b/\n\n" + V.FENCE_OPEN + "\n" + "\n" + V.FENCE_CLOSE)
    heads = F.aggregate(F.sequence(F.lit(1), F.col("posts")), F.lit(0), lambda s, i: s + F.length(F.concat(F.lit("[POST "), i.cast("string"), F.lit("]\n"))))
    return prompts.select("mode", "batch", "posts", (F.length("prompt") - heads - 2 * (F.col("posts") - 1) - frame * F.col("posts")).cast("long").alias("chars"))


@query("SELECT * FROM (SELECT c.conv_id || '' AS channel, turn AS message_id FROM conversations c WHERE turn > conv_id % 3 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 50)")
def delta_pull(spark, sf_dir):
    rows = T.messages(spark, sf_dir).select("channel", "message_id")
    cursors = rows.select("channel").distinct().withColumn("last_message_id", F.col("channel").cast("long") % 3)
    return select.delta_pull(rows, cursors).select("channel", "message_id")


@query("SELECT id, title, category, verification_status FROM offers WHERE title ILIKE '%order 1%' AND is_active ORDER BY first_seen DESC, id DESC LIMIT 100")
def offers_feed(spark, sf_dir):
    df = select.offers_feed(T.offers(spark, sf_dir), T.raw_items(spark, sf_dir), T.sources(spark, sf_dir), q="order 1", as_of=T.as_of())
    return df.select("id", "title", "category", "verification_status")


# --- validation, liveness ---------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 9 = 0 THEN 'not_offer' END, CASE WHEN o_orderkey % 8 = 0 THEN 'url' END, CASE WHEN o_orderkey % 7 = 0 THEN 'value' END, CASE WHEN o_orderkey % 6 = 0 THEN 'currency' END, CASE WHEN o_orderkey % 5 = 0 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS reasons,
CASE WHEN o_orderkey % 9 > 0 AND o_orderkey % 8 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 6 > 0 AND o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'cloud' ELSE 'other' END END AS category FROM orders""")
def validated_offers(spark, sf_dir):
    """Model replies made of orders: fenced JSON with broken fields."""
    k = F.col("o_orderkey")
    reply = F.struct((k % 9 != 0).alias("is_offer"), F.lit("A good title").alias("title"), F.when(k % 8 == 0, "x").otherwise("https://a.example").alias("url"), F.when(k % 2 == 0, " CLOUD ").otherwise("nonsense").alias("category"), F.when(k % 7 == 0, -5.0).otherwise(F.col("o_totalprice")).alias("value"), F.when(k % 6 == 0, "dollars").otherwise("usd").alias("currency"), F.when(k % 5 == 0, 1.5).otherwise(0.5).alias("confidence"))
    rows = T.table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("```json\n"), F.to_json(reply), F.lit("\n```")).alias("reply"))
    done = O.validate_offers(rows, "reply")
    return done.select("id", F.array_join("reject_reasons", ",").alias("reasons"), F.col("offer.category").alias("category"))


@query("""SELECT liveness, count(*) AS n, sum(CASE liveness WHEN 'live' THEN 840 WHEN 'unreachable' THEN 560 ELSE 800 END) AS confidence FROM (SELECT CASE WHEN page_id % 8 = 7 THEN 'unreachable' WHEN page_id % 8 = 0 THEN CASE WHEN contains(lower(left(html, 4000)), 'sold out') THEN 'soft_dead' ELSE 'live' END WHEN page_id % 8 IN (1, 2) THEN 'live' WHEN page_id % 8 IN (3, 4) THEN 'dead' WHEN page_id % 8 = 5 THEN 'unreachable' ELSE 'soft_dead' END AS liveness FROM pages) GROUP BY liveness""")
def liveness_counts(spark, sf_dir):
    """A probe log over the pages, and the confidence that each answer leaves (thousandths)."""
    m = F.col("page_id") % 8
    status = F.when(m == 0, 200).when(m == 1, 204).when(m == 2, 429).when(m == 3, 404).when(m == 4, 410).when(m == 5, 503).when(m == 6, 302)
    rows = T.table(spark, sf_dir, "pages").select(O.classify_liveness(status, F.lit("text/html"), F.col("html"), F.when(m == 7, "Timeout")).alias("liveness"))
    points = F.round(O.adjust_confidence(F.lit(0.8), F.col("liveness")) * 1000).cast("long")
    return rows.groupBy("liveness").agg(F.count("*").alias("n"), F.sum(points).alias("confidence"))


# --- deduplication -------------------------------------------------------------------------------


@query(f"SELECT doc_id AS id, min_id AS existing_offer_id FROM (SELECT doc_id, min(doc_id) FILTER (WHERE doc_id % 3 = 0) OVER (PARTITION BY c) AS min_id FROM (SELECT doc_id, {_clean_sql('url')} AS c FROM posts)) WHERE doc_id % 3 <> 0 AND min_id IS NOT NULL")
def url_gate(spark, sf_dir):
    rows = T.posts(spark, sf_dir).select(F.col("doc_id").alias("id"), U.clean_url(F.col("url")).alias("canonical_url"))
    known = rows.filter("id % 3 = 0").select(F.col("id").alias("offer_id"), O.sha256_hex(F.col("canonical_url")).alias("url_hash"))
    return dedup.url_gate(rows.filter("id % 3 <> 0"), known)


@query("SELECT c.id, min({'t': k.first_seen, 'i': k.id}).i AS existing_offer_id FROM offers c JOIN offers k ON lower(k.title) = lower(c.title) AND k.category = c.category AND k.first_seen > TIMESTAMP '1998-08-02' - INTERVAL 2000 DAY WHERE c.id % 2 = 1 AND k.id % 2 = 0 GROUP BY c.id")
def title_gate(spark, sf_dir):
    rows = T.offers(spark, sf_dir)
    known = rows.filter("id % 2 = 0")
    prints = known.select(F.col("id").alias("offer_id"), O.sha256_hex(F.lower("title")).alias("title_hash"))
    return dedup.title_gate(rows.filter("id % 2 = 1").select("id", "title", "category"), prints, known, as_of=T.as_of(), days=2000)


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS double[]), CAST(b.embedding AS double[])) >= 0.4")
def semantic_pairs(spark, sf_dir):
    vectors = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dedup.semantic_pairs(vectors, threshold=0.4).select("a", "b")


#: The loop itself: a row a step, with the list of what has been accepted.
_GREEDY_SQL = f""", items AS (SELECT doc_id AS id, {_clean_sql('url')} AS u, CASE WHEN coalesce(split_part(text, chr(10), 1), '') <> '' AND coalesce(source, '') <> '' THEN lower(split_part(text, chr(10), 1)) || ':' || source END AS t, doc_id % 10 = 0 AS known FROM posts),
unit AS (SELECT vec_id, CAST(embedding AS double[]) AS v FROM embeddings),
near AS (SELECT a.vec_id AS id, list({{'s': list_cosine_similarity(a.v, b.v), 'p': CASE WHEN b.vec_id % 10 = 0 THEN b.vec_id + 1 ELSE -b.vec_id END, 'id': b.vec_id}}) AS near
  FROM unit a JOIN unit b ON a.vec_id % 10 > 0 AND a.vec_id <> b.vec_id AND (b.vec_id % 10 = 0 OR b.vec_id < a.vec_id) AND list_cosine_similarity(a.v, b.v) >= 0.45 JOIN items ON items.id = b.vec_id GROUP BY a.vec_id),
queue AS (SELECT row_number() OVER (ORDER BY i.id) AS k, i.*, ku.id AS ku, kt.id AS kt, coalesce(near, []) AS near FROM items i LEFT JOIN (SELECT u, max(id) AS id FROM items WHERE known GROUP BY u) ku USING (u) LEFT JOIN (SELECT t, min(id) AS id FROM items WHERE known GROUP BY t) kt USING (t) LEFT JOIN near ON near.id = i.id WHERE NOT known)
SELECT id, basis IS NOT NULL AS is_dup, basis, CASE basis WHEN 'url' THEN hu WHEN 'title' THEN ht WHEN 'semantic' THEN hs.id END AS existing_offer_id, CASE WHEN basis = 'semantic' THEN round(hs.s, 4) END AS similarity FROM (
WITH RECURSIVE run AS (SELECT 0::bigint AS k, NULL::bigint AS id, NULL::varchar AS basis, NULL::bigint AS hu, NULL::bigint AS ht, NULL::STRUCT(s double, p bigint, id bigint) AS hs, []::STRUCT(id bigint, u varchar, t varchar)[] AS accepted
UNION ALL SELECT k, id, basis, hu, ht, hs, CASE WHEN basis IS NULL THEN list_append(accepted, {{'id': id, 'u': u, 't': t}}) ELSE accepted END FROM (
SELECT *, CASE WHEN hu IS NOT NULL THEN 'url' WHEN ht IS NOT NULL THEN 'title' WHEN hs IS NOT NULL THEN 'semantic' END AS basis FROM (
SELECT q.k, q.id, q.u, q.t, accepted, coalesce(q.ku, list_filter(accepted, lambda x: x.u = q.u)[1].id) AS hu, coalesce(q.kt, list_filter(accepted, lambda x: x.t = q.t)[1].id) AS ht,
list_sort(list_filter(q.near, lambda n: n.p > 0 OR list_contains(list_transform(accepted, lambda x: x.id), n.id)), 'DESC')[1] AS hs
FROM run JOIN queue q ON q.k = run.k + 1))) SELECT * FROM run WHERE k > 0)"""


@query(_GREEDY_SQL)
def greedy_dedup(spark, sf_dir):
    """All three gates over documents and embeddings, a tenth of them known offers."""
    vectors = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    title = F.split("text", "\n")[0]
    posts = T.posts(spark, sf_dir, title.alias("title")).join(vectors, "doc_id", "left")
    rows = posts.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("position"), U.clean_url(F.col("url")).alias("canonical_url"), "title", F.col("source").alias("category"), F.coalesce("embedding", F.array().cast("array<float>")).alias("embedding"))
    known = rows.filter("id % 10 = 0")
    offers = known.select("id", "category", T.as_of().alias("first_seen"))
    prints = known.select(F.col("id").alias("offer_id"), O.sha256_hex(F.col("canonical_url")).alias("url_hash"), O.sha256_hex(F.lower("title")).alias("title_hash"), "embedding")
    return dedup.dedup(rows.filter("id % 10 > 0"), prints, offers, as_of=T.as_of(), threshold=0.45)


# --- dispatch --------------------------------------------------------------------------------------


@query("SELECT o.id, x.name AS source_name FROM sendable o JOIN raw_items r ON r.id = o.raw_item_id JOIN sources x ON x.id = r.source_id WHERE NOT EXISTS (SELECT 1 FROM dispatches d WHERE d.offer_id = o.id AND d.status = 'sent')")
def dispatch_queue(spark, sf_dir):
    return dispatch.dispatch_queue(T.offers(spark, sf_dir), T.raw_items(spark, sf_dir), T.sources(spark, sf_dir), T.dispatches(spark, sf_dir), channel="discord").select("id", "source_name")


@query("SELECT o.id, d.status FROM sendable o JOIN raw_items r ON r.id = o.raw_item_id JOIN sources x ON x.id = r.source_id LEFT JOIN dispatches d ON d.offer_id = o.id WHERE d.id IS NULL OR d.status <> 'sent' ORDER BY d.created_at ASC NULLS LAST, o.first_seen, o.id LIMIT 50")
def dispatch_preview(spark, sf_dir):
    return dispatch.preview(T.offers(spark, sf_dir), T.raw_items(spark, sf_dir), T.sources(spark, sf_dir), T.dispatches(spark, sf_dir), channel="discord", limit=50).select("id", "status")


@query(""", due AS (SELECT d.* FROM dispatches d JOIN sendable o ON o.id = d.offer_id WHERE d.status <> 'sent'
UNION ALL SELECT -1, id, 'pending', 0, NULL, NULL, TIMESTAMP '1998-08-02' FROM (SELECT * FROM sendable o WHERE NOT EXISTS (SELECT 1 FROM dispatches d WHERE d.offer_id = o.id) ORDER BY first_seen, id LIMIT 200)),
slots AS (SELECT * FROM due ORDER BY created_at, id LIMIT 200)
SELECT offer_id, attempts + 1 AS attempts FROM slots WHERE (status = 'pending' AND (claimed_at IS NULL OR claimed_at < TIMESTAMP '1998-08-02' - INTERVAL 15 MINUTE)) OR (status = 'failed' AND attempts < 20)""")
def claimed_offers(spark, sf_dir):
    """The limit cuts before the lease test. The oldest 200 rows are all known ones here."""
    _, claimed, _ = dispatch.claim(T.offers(spark, sf_dir), T.dispatches(spark, sf_dir), channel="discord", limit=200, as_of=T.as_of())
    return claimed.select("offer_id", "attempts")


@query("SELECT d.id, d.offer_id, d.attempts FROM dispatches d JOIN offers o ON o.id = d.offer_id WHERE status = 'failed' AND attempts >= 20 AND category <> '5-LOW'")
def retry_ceiling(spark, sf_dir):
    return dispatch.ceiling(T.offers(spark, sf_dir), T.dispatches(spark, sf_dir), channel="discord", held=("5-LOW",))


@query("SELECT count(*) AS n FROM dispatches d JOIN offers o ON o.id = d.offer_id WHERE status = 'sent' AND sent_at >= TIMESTAMP '1995-06-01' AND category = '2-HIGH'")
def sent_since(spark, sf_dir):
    return dispatch.sent_today(T.offers(spark, sf_dir), T.dispatches(spark, sf_dir), channel="discord", category="2-HIGH", as_of=F.lit("1995-06-01 13:00:00").cast("timestamp"))


def _diverse_sql(k: int) -> str:
    """k picks in a row, each from what the ones before have left."""
    stop = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
    tags = f"list_distinct(['org:handle' || o_custkey % 50] || list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({stop})))"
    sql = f", cand AS MATERIALIZED (SELECT s.id, s.first_seen, {tags} AS tags FROM sendable s JOIN orders ON o_orderkey = s.id WHERE category = '2-HIGH' AND NOT EXISTS (SELECT 1 FROM dispatches d WHERE d.offer_id = s.id AND d.status = 'sent'))"
    sql += ", p0 AS (SELECT CAST([] AS varchar[]) AS seen, CAST([] AS bigint[]) AS taken)"
    for i in range(1, k + 1):
        sql += f", p{i} AS MATERIALIZED (SELECT seen || tags AS seen, taken || [id] AS taken FROM cand, p{i - 1} WHERE NOT list_contains(taken, id) ORDER BY len(list_filter(tags, lambda t: NOT list_contains(seen, t))) DESC, first_seen, id LIMIT 1)"
    return sql + f" SELECT id FROM cand, p{k} WHERE NOT list_contains(taken, id)"


@query(_diverse_sql(8))
def diverse_pick(spark, sf_dir):
    """Ids beyond the day's budget of one category: a greedy pick of the most diverse stays."""
    return dispatch.cap_exclusions(T.offers(spark, sf_dir), T.dispatches(spark, sf_dir), channel="discord", category="2-HIGH", cap=8, as_of=F.lit("2010-01-01 00:00:00").cast("timestamp"))


@query("""SELECT id, 'Order ' || (id % 501) || ' of ' || category AS title, CASE WHEN value IS NULL THEN '—' ELSE 'USD ' || format('{:,}', CAST(round_even(value, 0) AS bigint)) END AS value,
CASE WHEN expires_at < TIMESTAMP '1998-08-02' THEN '⚠️ Expired ' || CAST(-floor(epoch(expires_at - TIMESTAMP '1998-08-02') / 86400) AS bigint) || 'd ago' WHEN epoch(expires_at - TIMESTAMP '1998-08-02') < 3600 THEN '⏰ ' || CAST(floor(epoch(expires_at - TIMESTAMP '1998-08-02') / 60) AS bigint) || 'm left' WHEN epoch(expires_at - TIMESTAMP '1998-08-02') < 86400 THEN '⏰ ' || CAST(floor(epoch(expires_at - TIMESTAMP '1998-08-02') / 3600) AS bigint) || 'h left' ELSE '⏰ In ' || CAST(floor(epoch(expires_at - TIMESTAMP '1998-08-02') / 86400) AS bigint) || 'd' END AS expires, 6583435 AS color,
'```P' || id || '```' AS code, '`http://b.io/' || id || '`' AS base_url, 'o/r' || id AS repo, '""" + next(c[1] for c in V.CATEGORIES if c[0] == "other") + """ ' || CASE category WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium' WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' ELSE '5-Low' END || ' · Credit' AS type, 'a • b' AS requirements, '1. open' || chr(10) || '2. claim ' || id AS steps FROM offers""")
def rendered_messages(spark, sf_dir):
    """All eight fields of a message, its title and colour."""
    i = F.col("id").cast("string")
    raw = F.to_json(F.struct(F.concat(F.lit("P"), i).alias("promo_code"), F.concat(F.lit("http://b.io/"), i).alias("base_url"), F.concat(F.lit("o/r"), i).alias("github_repo"), F.array(F.lit("open"), F.concat(F.lit("claim "), i)).alias("exact_steps")))
    df = T.offers(spark, sf_dir).withColumns({"raw": raw, "offer_type": F.lit("credit"), "currency": F.lit("USD"), "requirements": F.lit('["a","b"]'), "url": F.lit("http://a.b/"), "canonical_url": F.lit(None).cast("string"), "description": F.lit("d"), "source_name": F.lit("s")})
    m = F.from_json("message", "title string, color int, fields array<struct<name:string,value:string,inline:boolean>>")
    field = lambda name: F.filter(F.col("m.fields"), lambda f: f["name"] == name)[0]["value"]
    named = {"value": "💰 Value", "expires": "⏳ Expires", "code": "🎟 Promo Code", "base_url": "🔗 API Base URL", "repo": "📦 Repository", "type": "🏷 Type", "requirements": "✅ Requirements", "steps": "📋 How to claim"}
    return dispatch.render_embeds(df, as_of=T.as_of()).select("id", m.alias("m")).select("id", "m.title", "m.color", *[field(name).alias(c) for c, name in named.items()])


# --- reports ------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active FROM offers")
def offer_totals(spark, sf_dir):
    return report.totals(T.offers(spark, sf_dir))


@query("SELECT verification_status, count(*) AS n FROM offers GROUP BY 1")
def offers_by_status(spark, sf_dir):
    return report.count_by(T.offers(spark, sf_dir), "verification_status")


@query("SELECT category, count(*) AS n FROM offers GROUP BY 1")
def offers_by_category(spark, sf_dir):
    return report.count_by(T.offers(spark, sf_dir), "category")


@query("SELECT status, count(*) AS n FROM dispatches GROUP BY 1")
def dispatches_by_status(spark, sf_dir):
    return report.count_by(T.dispatches(spark, sf_dir), "status")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE permanently_rejected) AS rejected, count(*) FILTER (WHERE NOT permanently_rejected AND NOT has_offer) AS unprocessed FROM state")
def item_counts(spark, sf_dir):
    return report.item_counts(T.raw_items(spark, sf_dir), T.offers(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM sendable) AS active_verified, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'sent') AS sent FROM dispatches")
def overview(spark, sf_dir):
    return report.overview(T.offers(spark, sf_dir), T.dispatches(spark, sf_dir))


@query("SELECT CAST(day AS date) AS day, count(o.id) AS n FROM generate_series(DATE '1998-07-27', DATE '1998-08-02', INTERVAL 1 DAY) AS t(day) LEFT JOIN offers o ON CAST(first_seen AS date) = CAST(day AS date) GROUP BY 1")
def daily_offers(spark, sf_dir):
    return report.daily_counts(T.offers(spark, sf_dir), as_of=T.as_of())


@query("SELECT stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(*) / max(count(*)) OVER (), 6) AS bar FROM (SELECT CASE WHEN has_offer THEN 'offer' WHEN permanently_rejected THEN 'rejected' WHEN attempts = 0 THEN 'untouched' ELSE 'retry' END AS stage FROM state) GROUP BY stage")
def funnel(spark, sf_dir):
    return report.funnel(T.raw_items(spark, sf_dir), T.offers(spark, sf_dir))


@query("SELECT split_part(last_reject_reason, ':', 1) AS stage, last_reject_reason AS reason, count(*) AS n FROM raw_items WHERE last_reject_reason IS NOT NULL GROUP BY ALL")
def reject_reasons(spark, sf_dir):
    return report.reject_reasons(T.raw_items(spark, sf_dir))


@query("SELECT last_reject_reason, count(*) AS n FROM raw_items WHERE last_attempted_at > TIMESTAMP '1998-02-01' - INTERVAL 15 MINUTE AND last_reject_reason IS NOT NULL GROUP BY 1")
def recent_reasons(spark, sf_dir):
    return report.recent_reasons(T.raw_items(spark, sf_dir), as_of=F.lit("1998-02-01").cast("timestamp"))


@query("SELECT x.name AS source_name, count(*) AS raw, count(*) FILTER (WHERE has_offer) AS offers, round(count(*) FILTER (WHERE has_offer) / count(*), 6) AS yield FROM state s JOIN sources x ON x.id = s.source_id GROUP BY 1")
def yield_per_source(spark, sf_dir):
    return report.yield_per_source(T.raw_items(spark, sf_dir), T.offers(spark, sf_dir), T.sources(spark, sf_dir))


@query("SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(*) / max(count(*)) OVER (), 6) AS bar FROM offers o JOIN dispatches d ON d.offer_id = o.id WHERE status = 'sent' GROUP BY category")
def sent_by_category(spark, sf_dir):
    return report.sent_by_category(T.offers(spark, sf_dir), T.dispatches(spark, sf_dir))


@query("SELECT count(*) AS n, round(quantile_cont(h, 0.5), 6) AS median_h, round(quantile_cont(h, 0.9), 6) AS p90_h, round(max(h), 6) AS max_h, count(*) FILTER (WHERE h > 24) AS over_a_day FROM (SELECT epoch(sent_at - first_seen) / 3600 AS h FROM offers o JOIN dispatches d ON d.offer_id = o.id WHERE status = 'sent')")
def send_latency(spark, sf_dir):
    return report.send_latency(T.offers(spark, sf_dir), T.dispatches(spark, sf_dir))


@query("SELECT coalesce(a.day, b.day) AS day, coalesce(ingested, 0) AS ingested, coalesce(drained, 0) AS drained FROM (SELECT CAST(fetched_at AS date) AS day, count(*) AS ingested FROM raw_items GROUP BY 1) a FULL JOIN (SELECT CAST(last_attempted_at AS date) AS day, count(*) AS drained FROM raw_items WHERE last_attempted_at IS NOT NULL GROUP BY 1) b ON a.day = b.day")
def ingest_vs_drain(spark, sf_dir):
    return report.ingest_vs_drain(T.raw_items(spark, sf_dir))


@query("SELECT id, offer_id, attempts FROM dispatches WHERE status = 'failed' ORDER BY id DESC LIMIT 5")
def recent_failures(spark, sf_dir):
    return report.recent_failures(T.dispatches(spark, sf_dir)).drop("last_error")


@query("SELECT id, title FROM offers ORDER BY first_seen DESC, id DESC LIMIT 6")
def newest_offers(spark, sf_dir):
    return report.newest_offers(T.offers(spark, sf_dir)).select("id", "title")


@query("SELECT 'offers' AS table_name, count(*) AS before, count(*) FILTER (WHERE is_active) AS after, count(*) FILTER (WHERE is_active) - count(*) AS delta FROM offers UNION ALL SELECT 'raw_items', count(*), count(*), 0 FROM raw_items")
def table_deltas(spark, sf_dir):
    o, r = T.offers(spark, sf_dir), T.raw_items(spark, sf_dir)
    return report.count_delta(report.table_counts(offers=o, raw_items=r), report.table_counts(offers=o.filter("is_active"), raw_items=r))


# --- state ------------------------------------------------------------------------------------------------


@query(""", good AS (SELECT source_id, max({'t': ts, 's': seq}) AS g FROM health WHERE ok GROUP BY 1)
SELECT h.source_id, max(ts) FILTER (WHERE ok) AS last_success, max(ts) FILTER (WHERE NOT ok) AS last_error, arg_max(error, {'t': ts, 's': seq}) FILTER (WHERE NOT ok) AS last_error_message, count(*) FILTER (WHERE NOT ok AND (g IS NULL OR {'t': ts, 's': seq} > g)) AS consecutive_failures FROM health h LEFT JOIN good USING (source_id) GROUP BY 1""")
def source_health(spark, sf_dir):
    return state.fold_health(T.health_events(spark, sf_dir))


@query("""SELECT r.id, r.attempts + coalesce(n, 0) AS attempts, CASE WHEN n IS NULL THEN permanently_rejected ELSE final OR r.attempts + n >= 3 END AS permanently_rejected, CASE WHEN n IS NULL THEN last_reject_reason ELSE why END AS last_reject_reason
FROM raw_items r LEFT JOIN (SELECT raw_item_id, count(*) AS n, arg_max(reason, {'t': ts, 's': seq}) AS why, arg_max(permanent, {'t': ts, 's': seq}) AS final FROM tries GROUP BY 1) a ON a.raw_item_id = r.id""")
def attempt_fold(spark, sf_dir):
    return state.fold_attempts(T.raw_items(spark, sf_dir), T.attempts(spark, sf_dir)).select("id", "attempts", "permanently_rejected", "last_reject_reason")


@query("SELECT conv_id || '' AS channel, max(CASE WHEN conv_id % 2 = 0 THEN greatest(turn, 5) ELSE turn END) AS last_message_id FROM conversations GROUP BY 1")
def cursor_advance(spark, sf_dir):
    rows = T.messages(spark, sf_dir).select("channel", "message_id")
    old = rows.filter(F.col("channel").cast("long") % 2 == 0).select("channel").distinct().withColumn("last_message_id", F.lit(5).cast("long"))
    return state.advance_cursors(old, rows)


@query("SELECT source, doc_id % 100 AS slot, max(doc_id) AS newest FROM documents GROUP BY ALL")
def upserted_items(spark, sf_dir):
    """A first load of the older half, then an upsert of the newer one."""
    docs = T.table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), (F.col("doc_id") % 100).cast("string").alias("external_id"), F.col("doc_id").cast("string").alias("raw_payload"), F.col("doc_id").alias("seq"))
    schema = docs.withColumns({"id": F.lit(1).cast("long"), "fetched_at": T.as_of(), "attempts": F.lit(0), "permanently_rejected": F.lit(False)}).drop("seq")
    first = state.upsert_raw_items(schema.limit(0), docs.filter("seq % 2 = 0"), as_of=T.as_of())
    both = docs.filter("seq % 2 = 1").join(first.select("source_id", "external_id", F.col("raw_payload").cast("long").alias("old")), ["source_id", "external_id"], "left")
    newer = both.filter("old is null or seq > old").drop("old")
    done = state.upsert_raw_items(first, newer, as_of=T.as_of())
    return done.select(F.col("source_id").alias("source"), F.col("external_id").cast("long").alias("slot"), F.col("raw_payload").cast("long").alias("newest"))


@query("SELECT id, status, sent_at IS NOT NULL AS sent FROM (SELECT id, CASE WHEN id % 2 = 0 AND status = 'pending' THEN CASE WHEN id % 4 = 0 THEN 'sent' ELSE 'failed' END ELSE status END AS status, CASE WHEN id % 4 = 0 AND status = 'pending' THEN TIMESTAMP '1998-08-02' ELSE sent_at END AS sent_at FROM dispatches)")
def send_outcomes(spark, sf_dir):
    d = T.dispatches(spark, sf_dir)
    results = d.filter("id % 2 = 0 AND status = 'pending'").select("id", F.when(F.col("id") % 4 == 0, "sent").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("meta"))
    return state.apply_outcomes(d, results, as_of=T.as_of()).select("id", "status", F.col("sent_at").isNotNull().alias("sent"))


@query("SELECT CAST(coalesce(sum(CASE WHEN o = 'x' THEN 1 END), 0) AS bigint) AS n, 'partial' AS status, CAST(count(*) AS bigint) AS fetched, count(*) FILTER (WHERE o = 'prefiltered') AS prefiltered, count(*) FILTER (WHERE o = 'error') AS errors FROM (SELECT CASE WHEN doc_id % 50 = 7 THEN 'error' WHEN r <> '' THEN 'prefiltered' ELSE 'written' END AS o FROM (SELECT doc_id, " + _reason_sql("text") + " AS r FROM documents))")
def run_audit(spark, sf_dir):
    """Outcomes of a run over all documents, as one audit row."""
    docs = T.spread(T.table(spark, sf_dir, "documents")).select(F.array(F.lit("u")).alias("urls"), X.prefilter_reason(F.col("text"), F.lit(False)).alias("prefilter"), F.lit("live").alias("liveness"), F.lit(True).alias("reply_seen"), F.array().cast("array<string>").alias("reject_reasons"), F.lit(None).cast("string").alias("dup_basis"), F.when(F.col("doc_id") % 50 == 7, "x").alias("error"))
    row = state.run_audit(extract.decide(docs), as_of=T.as_of())
    stats = F.from_json("stats", "fetched long, prefiltered long, errors long")
    return row.select(F.lit(0).cast("long").alias("n"), "status", stats.alias("s")).select("n", "status", "s.fetched", "s.prefiltered", "s.errors")


# --- streams: drained to a table, against their batch twins ---------------------------------------------------


def _stream(df: DataFrame, by: str) -> DataFrame:
    """``df`` as a stream of three micro-batches in order of ``by``."""
    return jobs.read(df.sparkSession, T.landed(df, "landed", by), df.schema, files_per_batch=1)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(ts AS date) AS day, count(*) AS n FROM events GROUP BY 1")
def daily_stream(spark, sf_dir):
    rows = _stream(_events(spark, sf_dir), "ts")
    return jobs.drained(jobs.daily_counts(rows, time_col="ts"), "daily_stream", mode="complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_stream(spark, sf_dir):
    """Keys seen within a window as long as the table."""
    rows = _stream(_events(spark, sf_dir), "ts")
    return jobs.drained(jobs.suppress_repeats(rows, keys=["user_id", "event_type"], time_col="ts", within="36500 days").select("user_id", "event_type"), "dedup_stream", mode="append")


@query(ORACLE_SQL["source_health"].removeprefix(T.VIEWS))
def health_stream(spark, sf_dir):
    rows = _stream(T.health_events(spark, sf_dir), "ts")
    return jobs.drained(jobs.source_health(rows), "health_stream", mode="update", keys=["source_id"])


@query("SELECT raw_item_id, sum(n)::bigint AS attempts, arg_max(permanent, last) OR sum(n) >= 3 AS dead, arg_max(reason, last) AS reason, string_agg(reason || ':' || n, ',' ORDER BY reason) AS reasons FROM (SELECT raw_item_id, reason, count(*) AS n, max({'t': ts, 's': seq}) AS last, arg_max(permanent, {'t': ts, 's': seq}) AS permanent FROM tries GROUP BY ALL) GROUP BY 1")
def retry_stream(spark, sf_dir):
    rows = _stream(T.attempts(spark, sf_dir), "ts")
    return jobs.drained(jobs.retry_counts(rows), "retry_stream", mode="update", keys=["raw_item_id"])


@query(""", e AS (SELECT user_id AS dispatch_id, CAST(ts AS timestamp) AS t, CASE event_id % 3 WHEN 0 THEN 'claimed' WHEN 1 THEN 'failed' ELSE 'sent' END AS event FROM events),
n AS (SELECT *, lead(t) OVER (PARTITION BY dispatch_id ORDER BY t, event) AS next FROM e)
SELECT dispatch_id, event, t AS "at" FROM e UNION ALL SELECT dispatch_id, 'expired', t + INTERVAL 15 MINUTE FROM n WHERE event = 'claimed' AND (next > t + INTERVAL 15 MINUTE OR next IS NULL AND t + INTERVAL 16 MINUTE <= (SELECT max(t) FROM e))""")
def lease_stream(spark, sf_dir):
    """Claims that nothing answers in 15 minutes end, by event-time timers."""
    rows = _events(spark, sf_dir).selectExpr("user_id AS dispatch_id", "ts", "CASE event_id % 3 WHEN 0 THEN 'claimed' WHEN 1 THEN 'failed' ELSE 'sent' END AS event")
    return jobs.drained(jobs.lease_expiry(_stream(rows, "ts")), "lease_stream", mode="append")


@query("SELECT source, doc_id % 100 AS slot, max(doc_id) AS newest FROM documents GROUP BY ALL")
def upsert_stream(spark, sf_dir):
    """Raw items upserted batch by batch."""
    rows = T.table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), (F.col("doc_id") % 100).cast("string").alias("external_id"), F.col("doc_id").cast("string").alias("raw_payload"), F.col("doc_id").alias("seq"))
    base = state.scratch(spark, "upsert_stream")
    schema = "source_id string, external_id string, raw_payload string, fetched_at timestamp"
    table = jobs.Table(spark, f"{base}/table", schema, keys=["source_id", "external_id"])
    jobs.ingest(spark, T.landed(rows, "landed", "seq"), table, f"{base}/checkpoint", schema=rows.schema, files_per_batch=1, available_now=True).awaitTermination()
    return table.read().select(F.col("source_id").alias("source"), F.col("external_id").cast("long").alias("slot"), F.col("raw_payload").cast("long").alias("newest"))


@query("SELECT CAST(conv_id % 20 AS varchar) AS channel, conv_id * 1000 + turn + 1 AS message_id, text FROM conversations")
def pulled_messages(spark, sf_dir):
    """Messages of channels that land in two parts; the second pull goes on where the first one's cursors are."""
    rows = T.table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id % 20 AS string) AS channel", "conv_id * 1000 + turn + 1 AS message_id", "text")
    base = state.scratch(spark, "pulled_messages")
    middle = rows.select(F.percentile_approx("message_id", 0.5)).first()[0] or 0
    for early in (True, False):
        rows.filter((F.col("message_id") <= middle) == F.lit(early)).repartition(4).write.mode("append").partitionBy("channel").parquet(f"{base}/land")
        got = jobs.drained(messages.pulled(spark, f"{base}/land"), "pulled_messages", mode="append", base=f"{base}/pull")
    return got


@query("SELECT id, category, title AS message FROM offers")
def sent_messages(spark, sf_dir):
    """Messages through the sink that commits each batch once, read back from committed files."""
    rows = T.offers(spark, sf_dir).select("id", "category", F.col("title").alias("message"))
    base = state.scratch(spark, "sent_messages")
    messages.send(_stream(rows, "id"), f"{base}/sent", f"{base}/checkpoint", available_now=True).awaitTermination()
    return messages.sent_messages(spark, f"{base}/sent", "id long, category string, message string")


from . import feed_queries, more_queries  # noqa: E402, F401  register their own
