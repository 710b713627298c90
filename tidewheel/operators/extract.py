"""From raw items to verdicts: normalising, prompts, replies, liveness, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import offers as O
from ..functions.text import clean_text, fence, prefilter_reason
from ..functions.urls import clean_url, extract_urls
from .state import written

CONTRACT = "struct<text:string,urls:array<string>,author_handle:string,published_at:string,engagement:string,extra:string>"


def normalize_items(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """raw_items (id, source_id, external_id, raw_payload JSON) ⋈ sources as clean items; urls of the cleaned text come first."""
    p = F.from_json("raw_payload", CONTRACT)
    dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"))
    df = raw.select(F.col("id").alias("raw_item_id"), "source_id", "external_id", p.alias("p")).join(dim, "source_id")
    df = df.withColumn("text", clean_text(F.col("p.text")))
    none = F.lit("{}")
    return df.select("raw_item_id", "source_id", "source_name", "source_kind", "external_id", "text", extract_urls(F.col("text"), F.col("p.urls")).alias("urls"), F.coalesce("p.author_handle", F.lit("")).alias("author_handle"), F.col("p.published_at").alias("published_at"), F.coalesce("p.engagement", none).alias("engagement"), F.coalesce("p.extra", none).alias("extra"))


def is_repo(extra: Column) -> Column:
    return F.coalesce(F.get_json_object(extra, "$.is_repo") == "true", F.lit(False))


def final_urls(resolutions: DataFrame, *, max_hops: int = 1024, by: tuple[str, ...] = ()) -> DataFrame:
    """Redirects (original, final) -> original, final: where following them ends. What runs into a circle, or goes over more than ``max_hops``, is left out.

    Of several targets of one URL the least counts. Pointer jumping: each round doubles the hops of all pointers, so a chain of
    50 takes six rounds. ``by``: columns within which redirects hold (a page's, a crawl's), where a URL may lead elsewhere than in others.
    """
    hops = written(resolutions.filter("final is not null and original <> final").groupBy(*by, "original").agg(F.min("final").alias("final")), "hops")
    for _ in range(max_hops.bit_length()):
        ahead = hops.select(*by, F.col("original").alias("final"), F.col("final").alias("far"))
        hops = written(hops.select(*by, "original", "final").join(ahead, [*by, "final"], "left").select(*by, "original", F.coalesce("far", "final").alias("final"), F.col("far").isNotNull().alias("moved")), "hops")
        if hops.filter("moved").isEmpty():
            return hops.select(*by, "original", "final")
    return hops.filter("not moved").select(*by, "original", "final")


def canonicalize(urls: DataFrame, resolutions: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """url -> final (as redirects end, else itself) and canonical; ``resolutions`` (original, final) joins on distinct URLs, each within its columns ``by``."""
    once = urls.select(*by, "url").distinct()
    final = once.join(final_urls(resolutions, by=by).withColumnRenamed("original", "url"), [*by, "url"], "left").withColumn("final", F.coalesce("final", "url"))
    return urls.join(final.withColumn("canonical_url", clean_url(F.col("final"))), [*by, "url"], "left")


def item_prompt(text: Column, urls: Column, *, cut: int = 3000) -> Column:
    """One item for a model: at most six URLs and fenced text."""
    shown = F.array_join(F.slice(F.coalesce(urls, F.array().cast("array<string>")), 1, 6), ", ")
    return F.concat(F.lit("URLs: "), F.when(shown == "", "(none)").otherwise(shown), F.lit("\n\n"), fence(F.substring(F.coalesce(text, F.lit("")), 1, cut)))


def batch_prompts(items: DataFrame, *, cut: int = 2000) -> DataFrame:
    """Items (mode, batch, position, text, urls) -> one prompt a batch, posts in order."""
    block = F.concat(F.lit("[POST "), (F.col("position") + 1).cast("string"), F.lit("]\n"), item_prompt(F.col("text"), F.col("urls"), cut=cut))
    rows = items.select("mode", "batch", F.struct("position", block.alias("block")).alias("post"))
    posts = rows.groupBy("mode", "batch").agg(F.array_sort(F.collect_list("post")).alias("posts"))
    return posts.select("mode", "batch", F.size("posts").alias("posts"), F.array_join(F.transform("posts", lambda p: p["block"]), "\n\n").alias("prompt"))


def parse_batch_replies(replies: DataFrame, batches: DataFrame) -> DataFrame:
    """Replies (mode, batch, reply) of batches (mode, batch, position, ...) -> one JSON a position, or null.

    A reply counts only if it holds exactly as many entries as its batch has posts.
    """
    raw = O.strip_code_fence(F.col("reply"))
    plain = F.from_json(raw, "array<string>")
    wrapped = F.from_json(raw, "struct<results:array<string>>")["results"]
    entries = F.when(raw.startswith("["), plain).otherwise(wrapped)
    size = batches.groupBy("mode", "batch").agg(F.count("*").alias("expected"))
    ok = replies.withColumn("entries", entries).join(size, ["mode", "batch"]).filter(F.size("entries") == F.col("expected"))
    rows = ok.select("mode", "batch", F.posexplode("entries").alias("position", "json"))
    return batches.join(rows, ["mode", "batch", "position"], "left")


def decide(items: DataFrame, *, require_live: bool = True) -> DataFrame:
    """Items (urls, prefilter, liveness, reply_seen, reject_reasons, dup_basis, error) -> outcome, reason, permanent.

    Temporary outcomes (no model, error) are tried again; the others end an item.
    """
    dead = F.col("liveness").isin("dead", "soft_dead") if require_live else F.lit(False)
    cases = [
        ("error", F.col("error").isNotNull(), F.concat(F.lit("error:"), F.col("error")), False),
        ("no_url", F.size("urls") <= 0, F.lit("no_url"), True),
        ("prefiltered", F.col("prefilter") != "", F.col("prefilter"), True),
        ("rejected", F.coalesce(dead, F.lit(False)), F.concat(F.lit("liveness:"), F.col("liveness")), True),
        ("retry", ~F.col("reply_seen"), F.lit("llm_unavailable"), False),
        ("rejected", F.size("reject_reasons") > 0, F.lit("llm_rejected"), True),
        ("dup", F.col("dup_basis").isNotNull(), F.concat(F.lit("dup:"), F.col("dup_basis")), True),
    ]
    outcome, reason, permanent = F.lit("written"), F.lit(None).cast("string"), F.lit(False)
    for name, test, why, final in reversed(cases):
        test = F.coalesce(test, F.lit(False))
        outcome, reason, permanent = F.when(test, name).otherwise(outcome), F.when(test, why).otherwise(reason), F.when(test, final).otherwise(permanent)
    return items.withColumns({"outcome": outcome, "reason": reason, "permanent": permanent})


def prefilter(items: DataFrame) -> DataFrame:
    return items.withColumn("prefilter", prefilter_reason(F.col("text"), is_repo(F.col("extra"))))


def build_offers(verdicts: DataFrame, *, as_of: Column) -> DataFrame:
    """Verdicts (raw_item_id, original_url, canonical_url, offer struct, liveness, http_status, author_handle, engagement) -> offers.

    The id is a hash of the raw item's id, so that tasks can be run again.
    """
    o = F.col("offer")
    audit = F.to_json(F.struct(o["reasons"].alias("reasons"), F.col("liveness").alias("liveness"), F.col("http_status").alias("http_status"), *[o[c].alias(c) for c in ("promo_code", "base_url", "github_repo", "exact_steps", "is_evergreen", "verification", "eligibility_required")]), {"ignoreNullFields": "false"})
    return verdicts.filter("offer is not null").select(
        F.xxhash64("raw_item_id").alias("id"), "raw_item_id", F.coalesce("original_url", o["url"]).alias("url"), F.coalesce("canonical_url", o["url"]).alias("canonical_url"),
        *[o[c].alias(c) for c in ("title", "description", "category", "offer_type")], o["value"].cast("decimal(12,2)").alias("value"), o["currency"].alias("currency"), o["expires_at"].alias("expires_at"), F.to_json(o["requirements"]).alias("requirements"),
        "author_handle", "engagement", F.when(F.col("liveness") == "live", "verified").otherwise("unconfirmed").alias("verification_status"), F.round(O.adjust_confidence(o["confidence"], F.col("liveness")), 3).cast("float").alias("confidence"),
        F.lit(True).alias("is_active"), as_of.alias("first_seen"), as_of.alias("last_seen"), audit.alias("raw"),
    )


def build_fingerprints(offers: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """(offer_id, url_hash, title_hash, embedding cut to 256 numbers)."""
    df = offers.select(F.col("id").alias("offer_id"), O.sha256_hex(F.col("canonical_url")).alias("url_hash"), O.sha256_hex(F.lower("title")).alias("title_hash"))
    none = F.array().cast("array<float>")
    if embeddings is None:
        return df.withColumn("embedding", none)
    return df.join(embeddings.select("offer_id", F.slice("embedding", 1, 256).alias("embedding")), "offer_id", "left").withColumn("embedding", F.coalesce("embedding", none))


def write_offers(offers: DataFrame, path: str) -> None:
    offers.write.mode("append").partitionBy("category").parquet(path)


