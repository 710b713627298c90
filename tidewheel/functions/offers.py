"""Offers: taxonomy, liveness, confidence, hashes, validation of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import normalize_title, strip

REQUIREMENTS = "struct<geography:array<string>,enrollment:array<string>,steps:array<string>,eligibility:array<string>>"
REPLY = (
    "struct<is_offer:string,title:string,description:string,url:string,category:string,offer_type:string,value:string,currency:string,expires_at:string,"
    f"requirements:{REQUIREMENTS},confidence:string,reasons:array<string>,promo_code:string,base_url:string,github_repo:string,exact_steps:array<string>,is_evergreen:string,verification:string,eligibility_required:string>"
)


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(V.CATEGORIES)], "position int, key string, emoji string, color int, description string")


def hex_color(color: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(color), 6, "0"))


def _coerce(c: Column, known: list[str]) -> Column:
    v = strip(F.lower(F.coalesce(c, F.lit("other"))))
    return F.when(v.isin(known), v).otherwise("other")


def is_valid_category(c: Column) -> Column:
    return F.coalesce(c.isin([c[0] for c in V.CATEGORIES]), F.lit(False))


def coerce_category(c: Column) -> Column:
    return _coerce(c, [c[0] for c in V.CATEGORIES])


def coerce_offer_type(c: Column) -> Column:
    return _coerce(c, V.OFFER_TYPES)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def classify_liveness(status: Column, content_type: Column, body: Column, error: Column) -> Column:
    html = (status == 200) & F.coalesce(content_type, F.lit("")).contains("text/html")
    soft = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 4000)).rlike("|".join(V.SOFT_DEAD))
    return (
        F.when(error.isNotNull() | status.isNull(), "unreachable")
        .when(status.between(200, 299), F.when(html & soft, "soft_dead").otherwise("live"))
        .when(status.isin(401, 403, 429), "live")
        .when(status.isin(404, 410), "dead")
        .when(status >= 500, "unreachable")
        .otherwise("soft_dead")
    )


def adjust_confidence(confidence: Column, liveness: Column) -> Column:
    changed = F.when(liveness == "live", F.least(F.lit(1.0), confidence * 1.05)).when(liveness == "unreachable", F.greatest(F.lit(0.0), confidence * 0.7)).otherwise(confidence)
    return F.round(changed, 3)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def strip_code_fence(reply: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def parse_reply(reply: Column) -> Column:
    """The reply's JSON object as a struct, or null."""
    return F.from_json(strip_code_fence(reply), REPLY)


def _flag(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("false"))).isin("true", "1", "1.0", "yes", "on", "y", "t")


def reject_reasons(o: Column) -> Column:
    """Every rule that a parsed reply breaks; empty if the offer is valid."""
    value, confidence = o["value"].try_cast("double"), o["confidence"].try_cast("double")
    title = normalize_title(o["title"])
    expiry = F.try_to_timestamp(o["expires_at"])
    rules = [
        ("unparsable", o.isNull()),
        ("not_offer", ~_flag(o["is_offer"])),
        ("title", o["title"].isNull() | ~F.length(o["title"]).between(4, 200) | (F.length(title) < 4)),
        ("url", o["url"].isNull() | (F.length(o["url"]) < 8)),
        ("description", F.length(o["description"]) > 2000),
        ("value", o["value"].isNotNull() & (value.isNull() | F.isnan(value) | (value < 0))),
        ("currency", F.length(o["currency"]) > 3),
        ("expires_at", o["expires_at"].isNotNull() & expiry.isNull()),
        ("confidence", o["confidence"].isNotNull() & (confidence.isNull() | F.isnan(confidence) | ~confidence.between(0, 1))),
        ("promo_code", F.length(o["promo_code"]) > 120),
        ("base_url", F.length(o["base_url"]) > 500),
        ("github_repo", F.length(o["github_repo"]) > 300),
        ("verification", F.length(o["verification"]) > 60),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))


def validate_offers(df: DataFrame, json_col: str) -> DataFrame:
    """Input columns plus ``offer`` (validated struct, null if rejected) and ``reject_reasons``."""
    parsed = df.withColumn("__reply", parse_reply(F.col(json_col)))
    o = F.col("__reply")
    reasons = F.when(o.isNull(), F.array(F.lit("unparsable"))).otherwise(reject_reasons(o))
    none = F.array().cast("array<string>")
    offer = F.struct(
        normalize_title(o["title"]).alias("title"),
        o["description"].alias("description"),
        o["url"].alias("url"),
        coerce_category(o["category"]).alias("category"),
        coerce_offer_type(o["offer_type"]).alias("offer_type"),
        o["value"].try_cast("double").alias("value"),
        F.nullif(F.upper(strip(o["currency"])), F.lit("")).alias("currency"),
        F.try_to_timestamp(o["expires_at"]).alias("expires_at"),
        o["requirements"].alias("requirements"),
        F.coalesce(o["confidence"].try_cast("double"), F.lit(0.5)).alias("confidence"),
        F.coalesce(o["reasons"], none).alias("reasons"),
        o["promo_code"].alias("promo_code"),
        o["base_url"].alias("base_url"),
        o["github_repo"].alias("github_repo"),
        F.coalesce(o["exact_steps"], none).alias("exact_steps"),
        _flag(o["is_evergreen"]).alias("is_evergreen"),
        o["verification"].alias("verification"),
        _flag(o["eligibility_required"]).alias("eligibility_required"),
    )
    marked = parsed.withColumn("reject_reasons", reasons)
    # exploded, so that fields of the offer that are read later do not each evaluate it anew
    one = F.explode(F.array(F.struct("reject_reasons", F.when(F.size("reject_reasons") == 0, offer).alias("offer")))).alias("__one")
    return marked.select(*df.columns, one).select(*df.columns, "__one.reject_reasons", "__one.offer")


def category_prompt_block(categories: DataFrame) -> DataFrame:
    """One row ``block``: a line for each category (position, key, description), keys padded to 15."""
    line = F.concat(F.when(F.length("key") < 15, F.rpad("key", 15, " ")).otherwise(F.col("key")), F.lit(" — "), F.col("description"))
    lines = categories.agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return lines.select(F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("block"))


def category_prompt_csv(categories: DataFrame) -> DataFrame:
    """One row ``keys``: all category keys in order."""
    keys = categories.agg(F.array_sort(F.collect_list(F.struct("position", "key"))).alias("keys"))
    return keys.select(F.array_join(F.transform("keys", lambda x: x["key"]), ", ").alias("keys"))


def taxonomy_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys that only one of two taxonomies has: (key, side)."""
    a, b = left.select("key"), right.select("key")
    return a.subtract(b).withColumn("side", F.lit("left")).union(b.subtract(a).withColumn("side", F.lit("right")))
