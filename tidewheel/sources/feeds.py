"""Feed records -> payload rows: (external_id, text, urls, author_handle, published_at, engagement, extra).

engagement and extra are JSON strings. ``as_of`` stands for the time of landing.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed_values as V
from ..functions import signals as S
from ..functions.text import python_title, strip
from ..functions.urls import is_noise_url, netloc


def _s(c: str | Column) -> Column:
    """The text of a column, empty for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _or(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _payload(df: DataFrame, external_id: Column, text: Column, urls: Column, handle: Column, published: Column, engagement: Column, extra: Column, *keep: str) -> DataFrame:
    return df.select(*keep, external_id.alias("external_id"), text.alias("text"), urls.alias("urls"), handle.alias("author_handle"), published.cast("string").alias("published_at"), engagement.alias("engagement"), extra.alias("extra"))


def _one(url: Column) -> Column:
    return F.array_compact(F.array(F.nullif(url, F.lit(""))))


NONE = "{}"


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in feed order."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def hn_select(hits: DataFrame, *, as_of: Column, lookback_days: int = 3, min_points: int = 5) -> DataFrame:
    """Hits (with term, term_pos, hit_pos) that are recent and liked; the first term of each wins."""
    cutoff = as_of.cast("timestamp").cast("long") - lookback_days * 86400
    return first_per_key(hits.filter((F.col("created_at_i") > cutoff) & (F.col("points") > min_points)), "objectID", "term_pos", "hit_pos")


def hn_payloads(hits: DataFrame) -> DataFrame:
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID"))
    text = F.regexp_replace(F.concat(_s("title"), F.lit(" — "), _s("story_text")), "^[ —]+|[ —]+$", "")
    engagement = _json(points=F.coalesce("points", F.lit(0)), num_comments=F.coalesce("num_comments", F.lit(0)))
    return _payload(hits, F.col("objectID"), text, F.array(_or(F.col("url"), page)), _s("author"), F.col("created_at"), engagement, _json(hn_id=F.col("objectID"), search_term=F.col("term"), hn_url=page))


def reddit_payloads(posts: DataFrame, *, as_of: Column, lookback_s: int = 259200, min_score: int = 3) -> DataFrame:
    recent = F.coalesce("created_utc", F.lit(0)) >= as_of.cast("timestamp").cast("long") - lookback_s
    ok = (_s("id") != "") & recent & (F.coalesce("score", F.lit(0)) >= min_score) & S.reddit_relevant(F.col("title"), F.col("selftext"), F.col("link_flair_text"))
    page = F.concat(F.lit("https://www.reddit.com"), _s("permalink"))
    text = strip(F.concat(_s("title"), F.lit(" "), F.substring(strip(_s("selftext")), 1, 3000)))
    engagement = _json(score=F.coalesce("score", F.lit(0)), upvote_ratio=F.col("upvote_ratio"), num_comments=F.coalesce("num_comments", F.lit(0)))
    extra = _json(subreddit=F.col("subreddit"), flair=F.col("link_flair_text"), reddit_url=page, is_self=F.coalesce("is_self", F.lit(False)))
    return _payload(posts.filter(ok), F.col("id"), text, F.array(_or(F.col("url"), page)), F.coalesce("author", F.lit("[deleted]")), _iso(F.timestamp_seconds(F.coalesce("created_utc", F.lit(0)))), engagement, extra)


def devto_payloads(articles: DataFrame, *, min_reactions: int = 5, max_items: int | None = None) -> DataFrame:
    """Articles (with query_tag, tag_pos, pos): liked and relevant first, then one a id, then the cap."""
    ok = (F.coalesce("positive_reactions_count", F.lit(0)) >= min_reactions) & S.devto_relevant(F.col("title"), F.col("description"), F.col("tag_list"), F.col("query_tag"))
    kept = first_per_key(articles.filter(ok), "id", "tag_pos", "pos")
    if max_items is not None:
        kept = kept.orderBy("tag_pos", "pos").limit(max_items)
    extra = _json(tags=F.coalesce("tag_list", F.array().cast("array<string>")), query_tag=F.col("query_tag"), reading_time_minutes=F.col("reading_time_minutes"), adapter=F.lit("devto_adapter"))
    engagement = _json(reactions=F.coalesce("positive_reactions_count", F.lit(0)), comments=F.coalesce("comments_count", F.lit(0)))
    handle = F.concat(F.lit("devto:"), F.coalesce(F.col("user")["username"], F.lit("unknown")))
    text = strip(F.concat(_s("title"), F.lit("\n"), _s("description")))
    return _payload(kept, F.concat(F.lit("devto:"), F.col("id").cast("string")), text, _one(F.coalesce(_or(F.col("url"), F.col("canonical_url")), F.lit(""))), handle, F.col("published_at"), engagement, extra)


ITEMS = "feed string, pos int, title string, url string, summary string, published_at string, guid string"
_ATOM = "{http://www.w3.org/2005/Atom}"


def _feed_items(cut: int):
    def text(node, *names: str) -> str:
        return next((v for n in names if (v := node.findtext(n))), "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for feed, xml in zip(pdf["feed"], pdf["xml"]):
                try:
                    root = ET.fromstring(xml or "")
                except ET.ParseError:
                    continue
                pos = 0
                for node in root.iter():
                    rss = node.tag == "item"
                    if not rss and node.tag != f"{_ATOM}entry":
                        continue
                    ns = "" if rss else _ATOM
                    link = text(node, "link").strip() if rss else next((x.get("href") for x in node.findall(f"{ns}link")), None) or ""
                    summary = text(node, "description") if rss else text(node, f"{ns}summary", f"{ns}content")
                    published = text(node, "pubDate") if rss else text(node, f"{ns}updated", f"{ns}published")
                    guid = (text(node, "guid" if rss else f"{ns}id") or link).strip()
                    if link:
                        rows.append((feed, pos, text(node, f"{ns}title").strip(), link, summary.strip()[:cut], published, guid))
                        pos += 1
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ITEMS.split(", ")])

    return run


def rss_items(xml: DataFrame, *, cut: int = 800, http_only: bool = True) -> DataFrame:
    """Items of RSS and Atom documents (feed, xml); a document that does not parse gives none."""
    items = xml.select("feed", "xml").mapInPandas(_feed_items(cut), ITEMS)
    return items.filter(F.col("url").startswith("http")) if http_only else items


def rss_payloads(items: DataFrame, feeds: DataFrame, *, as_of: Column) -> DataFrame:
    """Items ⋈ feeds (feed, category_hint): only deals, repositories or signals."""
    df = items.join(feeds, "feed", "left")
    both = F.concat(_s("title"), F.lit(" "), _s("summary"))
    repos = S.extract_github_repos(F.concat(both, F.lit(" "), _s("url")))
    signal = _or(S.classify_signal(both), F.col("category_hint"))
    hint = S.has_deal_hint(both)
    ok = _s("url").startswith("http") & ~(is_noise_url(F.col("url")) & ~hint) & (hint | (F.size(repos) > 0) | signal.isNotNull())
    key = F.concat(F.lit("rss:"), F.col("feed"), F.lit(":"), F.col("pos").cast("string"), F.lit(":"), F.right(F.col("url"), F.lit(40)))
    extra = _json(platform=F.lit("rss"), feed_name=F.col("feed"), signal_category=signal, github_repos=repos, adapter=F.lit("creator_mirrors"))
    return _payload(df.filter(ok), key, strip(F.concat(_s("title"), F.lit("\n"), _s("summary"))), F.array("url"), F.concat(F.lit("rss:"), F.col("feed")), F.coalesce(_or(F.col("published_at")), _iso(as_of)), F.lit(NONE), extra)


def launch_payloads(xml: DataFrame, *, as_of: Column) -> DataFrame:
    items = rss_items(xml, cut=1000, http_only=False).filter(S.launch_relevant(F.col("title"), F.col("summary")))
    extra = _json(platform=F.lit("producthunt"), feed_index=F.col("pos"), adapter=F.lit("producthunt_adapter"))
    return _payload(items, F.concat(F.lit("producthunt:"), _or(F.col("guid"), F.col("url"))), strip(F.concat(_s("title"), F.lit("\n"), _s("summary"))), _one(F.col("url")), F.lit("producthunt.com"), F.coalesce(_or(F.col("published_at")), _iso(as_of)), F.lit(NONE), extra)


def free_model_payloads(models: DataFrame, *, as_of: Column) -> DataFrame:
    """Models (pricing struct<prompt, completion> of strings) whose both prices are zero."""

    def free(c: str) -> Column:
        return F.coalesce(F.trim(F.coalesce(_or(F.col("pricing")[c]), F.lit("1"))).try_cast("double") == 0, F.lit(False))

    name = _or(F.col("name"), _s("id"))
    size = F.col("context_length")
    about = F.array_compact(F.array(_or(F.col("description")), F.when(size > 0, F.concat(F.lit("Context: "), F.format_number(size, 0), F.lit(" tokens."))), F.lit("Free tier: $0 prompt + $0 completion via OpenRouter.")))
    url = F.concat(F.lit("https://openrouter.ai/"), _s("id"))
    text = F.concat_ws("\n", F.concat(F.lit("Free LLM API via OpenRouter: "), F.coalesce(name, F.lit(""))), F.array_join(about, " "), F.concat(F.lit("Model ID: "), _s("id")), F.concat(F.lit("URL: "), url))
    extra = _json(model_id=_s("id"), context_length=size, pricing=F.col("pricing"), source_adapter=F.lit("openrouter_adapter"))
    return _payload(models.filter(free("prompt") & free("completion")), _s("id"), text, F.array(url), F.lit("openrouter.ai"), _iso(as_of), F.lit(NONE), extra)


def repo_payloads(repos: DataFrame, *, as_of: Column, min_stars: int = 50, within_days: int = 30, max_repos: int = 25) -> DataFrame:
    """Repositories (with facet_pos, pos): young and starred, one a URL in facet order, capped."""
    url, name, home = F.trim(_s("html_url")), F.trim(_or(F.col("full_name"), F.col("name"), F.lit(" "))), F.trim(_s("homepage"))
    stars = F.coalesce(F.col("stargazers_count").cast("long"), F.lit(0))
    since = F.date_sub(as_of.cast("date"), within_days)
    ok = (url != "") & (name != "") & (stars >= min_stars) & (F.to_date(F.substring("created_at", 1, 10)) >= since)
    kept = first_per_key(repos.filter(ok), "html_url", "facet_pos", "pos").orderBy("facet_pos", "pos").limit(max_repos)
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    text = F.regexp_replace(F.concat(name, F.lit(" ("), stars.cast("string"), F.lit("★): "), F.trim(_s("description"))), r"\s+$", "")
    text = F.when(F.size(topics) > 0, F.concat(text, F.lit("\nTopics: "), F.array_join(topics, ", "))).otherwise(text)
    urls = F.array_compact(F.array(url, F.when(home.startswith("http") & (home != url), home)))
    owner = F.when(name.contains("/"), F.split(name, "/")[0]).otherwise("github-trending")
    extra = _json(adapter=F.lit("github_trending_adapter"), repo=name, stars=stars, language=F.col("language"), topics=topics, created_at=F.col("created_at"), pushed_at=F.col("pushed_at"), homepage=_or(home), is_repo=F.lit(True))
    return _payload(kept, url, text, urls, F.concat(F.lit("github:"), owner), F.col("created_at"), _json(stars=stars, forks=F.coalesce(F.col("forks_count").cast("long"), F.lit(0))), extra)


def markdown_links(files: DataFrame, *, section_filter: bool = True) -> DataFrame:
    """Links of Markdown files (file, content) with the heading above each: file, line, pos, section, text, url, raw_line."""
    lines = files.select("file", F.posexplode(F.split("content", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")).alias("line", "raw"))
    return linked_lines(lines, section_filter=section_filter)


def linked_lines(lines: DataFrame, *, section_filter: bool = True) -> DataFrame:
    """``markdown_links`` of files that come line by line (file, line, raw)."""
    found = F.regexp_extract("raw", r"(?U)^#{1,6}\s+(.+)$", 1)
    lines = lines.withColumn("heading", F.nullif(F.lower(strip(found)), F.lit("")))
    w = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit("general"))).filter("heading is null")
    if section_filter:
        lines = lines.filter(F.col("section").isin(V.HIGH_SIGNAL_SECTIONS) | F.lower("raw").contains("free"))
    link = r"\[([^\]]+)\]\((https?://[^)]+)\)"
    pairs = F.arrays_zip(F.regexp_extract_all("raw", F.lit(link), F.lit(1)).alias("text"), F.regexp_extract_all("raw", F.lit(link), F.lit(2)).alias("url"))
    rows = lines.select("file", "line", "section", F.substring(strip(F.col("raw")), 1, 300).alias("raw_line"), F.posexplode(pairs).alias("pos", "link"))
    host = F.lower(netloc(F.col("link.url")))
    return rows.filter((host != "") & ~host.isin(V.MARKDOWN_SKIP_HOSTS)).select("file", "line", "pos", "section", strip(F.col("link.text")).alias("text"), strip(F.col("link.url")).alias("url"), "raw_line")


def markdown_payloads(links: DataFrame) -> DataFrame:
    text = F.concat(python_title(F.col("section")), F.lit(": "), F.col("raw_line"))
    return _payload(links, F.col("url"), text, F.array("url"), F.concat(F.lit("github:"), F.col("file")), F.lit(None), F.lit(NONE), _json(section=F.col("section"), repo=F.col("file"), link_text=F.col("text")))


def trending_html_repos(pages: DataFrame, *, top: int = 25) -> DataFrame:
    """Repository names in a trending page's headings (page, html): page, pos, repo, url."""
    pattern = r'(?s)<h2[^>]*class="[^"]*lh-condensed[^"]*"[^>]*>\s*<a[^>]*href="/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"'
    found = F.slice(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), 1, top)
    return pages.select("page", F.posexplode(found).alias("pos", "repo")).withColumn("url", F.concat(F.lit("https://github.com/"), "repo"))


_LINKS = "array<struct<url:string,link:string,title:string,label:string>>"


def bio_payloads(pages: DataFrame, *, platform: str, as_of: Column) -> DataFrame:
    """Bio pages (handle, idx, html: a page with embedded JSON, or an answer with ``blocks``): all deal links of one as one payload."""
    blob = F.regexp_extract("html", r"""(?s)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>([^<]+)</script>""", 1)
    shape = f"struct<props:struct<pageProps:struct<account:struct<links:{_LINKS}>,links:{_LINKS}>>>"
    page = F.from_json(blob, shape)["props"]["pageProps"]
    first, second = page["account"]["links"], page["links"]
    blocks = F.from_json(F.when(F.ltrim("html").startswith("{"), F.col("html")), f"struct<blocks:{_LINKS}>")["blocks"]
    raw = F.when(F.size(first) > 0, first).otherwise(F.coalesce(second, blocks, F.array().cast(_LINKS)))
    links = F.transform(raw, lambda x: F.struct(_s(_or(x["url"], x["link"])).alias("url"), _s(_or(x["title"], x["label"])).alias("title")))
    ok = lambda x: x["url"].startswith("http") & (~is_noise_url(x["url"]) | S.has_deal_hint(F.concat(x["title"], F.lit(" "), x["url"])))
    df = pages.withColumn("__links", F.filter(links, ok)).filter(F.size("__links") > 0)
    urls, titles = F.transform("__links", lambda x: x["url"]), F.filter(F.transform("__links", lambda x: x["title"]), lambda t: t != "")
    text = _or(F.array_join(titles, " | "), urls[0])
    all_urls = F.array_join(urls, " ")
    key = F.concat(F.lit(f"{platform}:"), F.col("handle"), F.lit(":"), F.col("idx").cast("string"), F.lit(":"), urls[0])
    extra = _json(platform=F.lit(platform), handle=F.col("handle"), signal_category=S.classify_signal(F.concat(text, F.lit(" "), all_urls)), github_repos=S.extract_github_repos(all_urls))
    return _payload(df, key, text, urls, F.concat(F.lit(f"{platform}:"), F.col("handle")), _iso(as_of), F.lit(NONE), extra)


def message_payloads(messages: DataFrame) -> DataFrame:
    """Channel messages (channel, message_id, date, text, entity_urls, views, forwards); key is the message id."""
    urls = F.array_distinct(F.concat(F.filter(F.coalesce("entity_urls", F.array().cast("array<string>")), lambda u: _s(u) != ""), F.regexp_extract_all(_s("text"), F.lit(r"https?://(?U:\S+)"), F.lit(0))))
    df = messages.filter("message_id is not null").withColumn("__urls", urls).filter((_s("text") != "") | (F.size("__urls") > 0))
    extra = _json(channel=F.col("channel"), message_id=F.col("message_id"), date=F.col("date"), views=F.col("views"), forwards=F.col("forwards"))
    # the source gives date, views and forwards under names that the payload contract does not know
    return _payload(df, F.col("message_id").cast("string"), _s("text"), F.col("__urls"), F.lit(None).cast("string"), F.lit(None), F.lit(NONE), extra, "channel", "message_id")


def search_payloads(results: DataFrame) -> DataFrame:
    """Search results (url, title, snippet, query, category_tag)."""
    df = results.filter(F.col("url").startswith("http"))
    extra = _json(search_query=F.col("query"), category_tag=F.col("category_tag"), adapter=F.lit("deep_web_adapter"))
    return _payload(df, F.substring(F.sha2("url", 256), 1, 16), F.concat(_s("title"), F.lit("\n"), F.substring(_s("snippet"), 1, 500)), F.array("url"), F.lit("deep_web_search"), F.lit(None), F.lit(NONE), extra)


def extract_payloads(extracts: DataFrame) -> DataFrame:
    """Page extracts (scraped_url, handle, is_offer, title, description, direct_url, claiming_steps, promo_code, value, currency, expires_at, category)."""
    title, steps = strip(_s("title")), F.coalesce("claiming_steps", F.array().cast("array<string>"))
    df = extracts.filter(F.coalesce("is_offer", F.lit(False)) & (F.length(title) >= 4))
    direct = strip(_or(F.col("direct_url"), F.col("scraped_url")))
    text = F.concat(title, F.lit("\n"), _s("description"), F.lit("\n"), F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"))
    extra = _json(adapter=F.lit("firecrawl_adapter"), source_url=F.col("scraped_url"), promo_code=F.col("promo_code"), value=F.col("value"), currency=F.col("currency"), expires_at=F.col("expires_at"), claiming_steps=steps, category_hint=F.col("category"))
    return _payload(df, F.substring(F.sha2("scraped_url", 256), 1, 20), text, F.array_distinct(F.array(direct, F.col("scraped_url"))), F.col("handle"), F.lit(None), F.lit(NONE), extra)


def manual_payloads(posts: DataFrame, *, as_of: Column, default_handle: str = "manual") -> tuple[DataFrame, DataFrame]:
    """(accepted payloads, rejected rows with a reason) of hand-made posts (text, urls, author_handle)."""
    text = strip(_s("text"))
    urls = F.coalesce("urls", F.array().cast("array<string>"))
    reason = (
        F.when(F.length(text) < 10, "text_too_short")
        .when(F.length(text) > 4000, "text_too_long")
        .when(F.size(urls) > 8, "too_many_urls")
        .when(~F.forall(urls, lambda u: F.coalesce(u.rlike(r"(?i)^https?://\S+$"), F.lit(False))), "bad_url")
    )
    marked = posts.withColumn("reject_reason", reason)
    handle = F.coalesce(_or(F.substring(strip(_s("author_handle")), 1, 120)), F.lit(default_handle))
    key = F.concat(F.lit("manual:"), F.sha2(F.concat_ws("\n", text, F.array_join(urls, "\n")), 256))
    accepted = _payload(marked.filter("reject_reason is null"), key, text, urls, handle, _iso(as_of), F.lit(NONE), _json(adapter=F.lit("manual")))
    return accepted, marked.filter("reject_reason is not null")


def site_pages(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """URLs (site, url) that hold their site's path fragment (site, path_fragment: a small dimension)."""
    return urls.join(sites, "site").filter(F.col("url").contains(F.col("path_fragment"))).select(urls.columns)


def select_templates(templates: DataFrame, lanes: DataFrame, *, lane: str, gated: list[str] | None = None) -> DataFrame:
    """Templates (tag, query) of a lane (lane, tags): an empty list of tags means all; gated tags are left out."""
    wanted = lanes.filter(F.col("lane") == lane).select("tags")
    some = wanted.select(F.explode("tags").alias("tag")).distinct()
    kept = templates if some.isEmpty() else templates.join(some, "tag", "left_semi")
    return kept.filter(~F.col("tag").isin(gated)) if gated else kept


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON lines with a given schema: no inference pass."""
    return spark.read.schema(schema).json(path)
