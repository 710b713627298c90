"""The dispatch queue as functions: queue, gate, claim with leases, preview, daily cap, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import fixed_values as V
from ..functions.offers import taxonomy
from ..functions.signals import diversity_tags
from ..functions.text import format_value, humanize_expiry, python_title, truncate
from .state import written


def validate_channel(channel: str) -> str:
    if channel not in V.CHANNELS:
        raise ValueError(f"channel must be one of {', '.join(V.CHANNELS)}")
    return channel


def sendable(offers: DataFrame, *, category: str | None = None, held: tuple[str, ...] = (), exclude: DataFrame | None = None) -> DataFrame:
    df = offers.filter(F.col("is_active") & F.col("verification_status").isin("verified", "live"))
    if category:
        df = df.filter(F.col("category") == category)
    if held:
        df = df.filter(~F.col("category").isin(*held))
    return df.join(exclude.select("id").distinct(), "id", "left_anti") if exclude is not None else df


def _of(dispatches: DataFrame, channel: str) -> DataFrame:
    return dispatches.filter(F.col("channel") == validate_channel(channel))


def with_source(offers: DataFrame, raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Offers that have an item and a source, with the source's name."""
    item = raw.select(F.col("id").alias("raw_item_id"), "source_id")
    return offers.join(item, "raw_item_id").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")


def dispatch_queue(offers: DataFrame, raw: DataFrame, sources: DataFrame, dispatches: DataFrame, *, channel: str) -> DataFrame:
    """Sendable offers that were never sent on the channel."""
    sent = _of(dispatches, channel).filter("status = 'sent'").select(F.col("offer_id").alias("id"))
    return with_source(sendable(offers).join(sent, "id", "left_anti"), raw, sources)


def has_undispatched(offers: DataFrame, dispatches: DataFrame, *, channel: str, held: tuple[str, ...] = ()) -> bool:
    sent = _of(dispatches, channel).filter("status = 'sent'").select(F.col("offer_id").alias("id"))
    return not sendable(offers, held=held).join(sent, "id", "left_anti").limit(1).isEmpty()


def ceiling(offers: DataFrame, dispatches: DataFrame, *, channel: str, category: str | None = None, held: tuple[str, ...] = (), max_reclaim: int = V.MAX_RECLAIM) -> DataFrame:
    """Failed rows that are not tried again."""
    rows = _of(dispatches, channel).filter((F.col("status") == "failed") & (F.col("attempts") >= max_reclaim))
    known = offers.select(F.col("id").alias("offer_id"), "category")
    df = rows.join(known, "offer_id")
    if category:
        df = df.filter(F.col("category") == category)
    return (df.filter(~F.col("category").isin(*held)) if held else df).select("id", "offer_id", "attempts")


def enqueue(offers: DataFrame, dispatches: DataFrame, *, channel: str, limit: int, as_of: Column, **which) -> DataFrame:
    """New pending rows for the oldest sendable offers without a row."""
    have = _of(dispatches, channel).select(F.col("offer_id").alias("id"))
    new = sendable(offers, **which).join(have, "id", "left_anti").orderBy("first_seen", "id").limit(limit)
    columns = {"id": F.xxhash64("id", F.lit(channel)), "offer_id": F.col("id"), "channel": F.lit(channel), "status": F.lit("pending"), "attempts": F.lit(0), "created_at": as_of}
    return new.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in dispatches.schema.fields])


def claim(offers: DataFrame, dispatches: DataFrame, *, channel: str, limit: int, category: str | None = None, held: tuple[str, ...] = (), exclude: DataFrame | None = None, as_of: Column, lease_minutes: int = V.LEASE_MINUTES, max_reclaim: int = V.MAX_RECLAIM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dispatches after the claim, claimed rows, rows at the ceiling).

    The limit applies to the oldest unsent rows before the lease test, so leased and hopeless rows use up slots.
    """
    which = {"category": category, "held": held, "exclude": exclude}
    rows = dispatches.unionByName(enqueue(offers, dispatches, channel=channel, limit=limit, as_of=as_of, **which))
    due = _of(rows, channel).filter("status <> 'sent'").join(sendable(offers, **which).select(F.col("id").alias("offer_id")), "offer_id", "left_semi")
    slots = due.orderBy("created_at", "id").limit(limit).select("id").withColumn("__slot", F.lit(True))
    expired = F.col("claimed_at") < as_of - F.make_interval(mins=F.lit(lease_minutes))
    free = ((F.col("status") == "pending") & (F.col("claimed_at").isNull() | expired)) | ((F.col("status") == "failed") & (F.col("attempts") < max_reclaim))
    won = F.coalesce(F.col("__slot") & free, F.lit(False))
    after = rows.join(F.broadcast(slots), "id", "left").withColumn("__won", won)  # limit rows
    after = after.withColumns({"claimed_at": F.when(F.col("__won"), as_of).otherwise(F.col("claimed_at")), "attempts": F.col("attempts") + F.col("__won").cast("int")})
    claimed = after.filter("__won").select(dispatches.columns)
    return after.select(dispatches.columns), claimed, ceiling(offers, dispatches, channel=channel, category=category, held=held, max_reclaim=max_reclaim)


def preview(offers: DataFrame, raw: DataFrame, sources: DataFrame, dispatches: DataFrame, *, channel: str, limit: int, **which) -> DataFrame:
    """What a claim would send, read only: known rows by age, then new offers by first_seen."""
    own = _of(dispatches, channel).select(F.col("offer_id").alias("id"), F.col("id").alias("dispatch_id"), "status", F.col("created_at").alias("queued_at"))
    df = with_source(sendable(offers, **which), raw, sources).join(own, "id", "left").filter("dispatch_id is null or status <> 'sent'")
    return df.orderBy(F.asc_nulls_last("queued_at"), "first_seen", "id").limit(limit)


def sent_today(offers: DataFrame, dispatches: DataFrame, *, channel: str, category: str, as_of: Column) -> DataFrame:
    own = offers.filter(F.col("category") == category).select(F.col("id").alias("offer_id"))
    return _of(dispatches, channel).filter((F.col("status") == "sent") & (F.col("sent_at") >= F.date_trunc("day", as_of))).join(own, "offer_id", "left_semi").agg(F.count("*").alias("n"))


def diversify(candidates: DataFrame, *, k: int, lane_col: str) -> DataFrame:
    """Of each lane (candidates with position and tags) the k that cover most new tags, greedily; ties to the least position.

    Of rows with the same tags only the k of least position can be picked, so the others go first (each task drops its own before
    the shuffle). Then k rounds, each one aggregate that finds the best of every lane; lanes are
    categories, so what the driver holds (k picks a lane and their tags) is bounded.
    """
    spark = candidates.sparkSession
    alike = W.partitionBy(lane_col, F.array_sort("tags")).orderBy("position")
    rows = written(candidates.withColumn("__place", F.row_number().over(alike)).filter(F.col("__place") <= k).drop("__place"), "candidates")
    keys = rows.select(lane_col, "position")
    none = F.array().cast("array<string>")
    picks: dict = {}
    for _ in range(k):
        known = spark.createDataFrame([(lane, sorted(set().union(*[t for _, t in got])), [p for p, _ in got]) for lane, got in picks.items()], StructType([rows.schema[lane_col], StructField("seen", ArrayType(StringType())), StructField("taken", ArrayType(rows.schema["position"].dataType))]))
        left = rows.join(F.broadcast(known), lane_col, "left").filter(~F.coalesce(F.array_contains("taken", F.col("position")), F.lit(False)))
        gain = F.size(F.array_except("tags", F.coalesce("seen", none)))
        best = left.groupBy(lane_col).agg(F.min_by(F.struct("position", "tags"), F.struct(-gain, "position")).alias("best")).collect()
        if not best:
            break
        for lane, (position, tags) in best:
            picks.setdefault(lane, []).append((position, tags))
    picked = spark.createDataFrame([(lane, p) for lane, got in picks.items() for p, _ in got], keys.schema)
    return rows.join(F.broadcast(picked), [lane_col, "position"], "left_semi").select(candidates.columns)


def cap_exclusions(offers: DataFrame, dispatches: DataFrame, *, channel: str, category: str, cap: int = V.DAILY_CAP, as_of: Column, held: tuple[str, ...] = ()) -> DataFrame:
    """Ids to leave out of today's run: what exceeds the day's budget, the least diverse first."""
    if category in held:
        return offers.select("id").limit(0)
    sent = _of(dispatches, channel).filter("status = 'sent'").select(F.col("offer_id").alias("id"))
    waiting = sendable(offers, category=category).join(sent, "id", "left_anti")
    budget = max(0, cap - sent_today(offers, dispatches, channel=channel, category=category, as_of=as_of).first()[0])
    if not budget:
        return waiting.select("id")
    repo = F.get_json_object("raw", "$.github_repo")
    order = F.struct("first_seen", "id")
    rows = waiting.select("id", F.lit(category).alias("lane"), order.alias("__order"), diversity_tags(F.col("title"), repo, F.col("author_handle")).alias("tags"))
    rows = rows.select("id", "lane", F.concat(F.date_format("__order.first_seen", "yyyyMMddHHmmss.SSSSSS"), F.lpad(F.col("id").cast("string"), 20, "0")).alias("position"), "tags")
    kept = diversify(rows, k=budget, lane_col="lane").select("id")
    return waiting.select("id").join(kept, "id", "left_anti")


def route(df: DataFrame, routes: DataFrame, *, default: str) -> DataFrame:
    """Adds the channel key of each row's category (routes: category, route; a small dimension)."""
    return df.join(routes, "category", "left").withColumn("route", F.coalesce(F.nullif(F.trim("route"), F.lit("")), F.lit(default)))


def render_embeds(offers: DataFrame, *, as_of: Column) -> DataFrame:
    """(id, message): one JSON message an offer, optional fields first, lengths limited."""
    styles = taxonomy(offers.sparkSession).select("key", "emoji", "color")
    df = offers.withColumn("__key", F.coalesce("category", F.lit("other"))).join(styles.withColumnRenamed("key", "__key"), "__key", "left")
    other = next(c for c in V.CATEGORIES if c[0] == "other")
    emoji, color = F.coalesce("emoji", F.lit(other[1])), F.coalesce("color", F.lit(other[2]))
    raw = F.from_json("raw", "promo_code string, base_url string, github_repo string, exact_steps array<string>")
    wants = F.from_json("requirements", "geography array<string>, enrollment array<string>, steps array<string>, eligibility array<string>")
    none = F.array().cast("array<string>")
    listed = F.flatten(F.array(*[F.coalesce(wants[c], none) for c in ("geography", "enrollment", "steps", "eligibility")]))
    listed = F.when(F.col("requirements").startswith("["), F.coalesce(F.from_json("requirements", "array<string>"), none)).otherwise(F.coalesce(listed, none))
    steps = F.transform(F.slice(raw["exact_steps"], 1, 6), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    top = V.LIMITS["field_value"]

    def field(name: str, value: Column, inline: bool | None, when: Column | None = None) -> Column:
        f = F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).cast("boolean").alias("inline"))
        return F.when(when, f) if when is not None else f

    has = lambda c: F.coalesce(c, F.lit("")) != ""
    kind = F.concat(emoji, F.lit(" "), python_title(F.replace(F.col("__key"), F.lit("_"), F.lit(" "))), F.lit(" · "), python_title(F.coalesce("offer_type", F.lit("other"))))
    fields = F.array_compact(F.array(
        field("🎟 Promo Code", F.concat(F.lit("```"), raw["promo_code"], F.lit("```")), False, has(raw["promo_code"])),
        field("🔗 API Base URL", truncate(F.concat(F.lit("`"), raw["base_url"], F.lit("`")), top), False, has(raw["base_url"])),
        field("📦 Repository", truncate(raw["github_repo"], top), False, has(raw["github_repo"])),
        field("🏷 Type", kind, True),
        field("💰 Value", format_value(F.col("value"), F.col("currency")), True),
        field("⏳ Expires", humanize_expiry(F.col("expires_at"), as_of), True),
        field("✅ Requirements", truncate(F.array_join(listed, " • "), top), None, F.size(listed) > 0),
        field("📋 How to claim", truncate(F.array_join(steps, "\n"), top), False, F.size(steps) > 0),
    ))
    author = F.when(has(F.col("author_handle")), F.struct(F.col("author_handle").alias("name")))
    footer = F.struct(F.concat(F.lit("via "), F.coalesce("source_name", F.lit("unknown")), F.lit(" · first seen "), F.coalesce(F.col("first_seen").cast("string"), F.lit("?"))).alias("text"))
    body = F.struct(
        truncate(F.col("title"), V.LIMITS["title"]).alias("title"), F.coalesce("canonical_url", "url").alias("url"), truncate(F.coalesce("description", F.lit("")), V.LIMITS["description"]).alias("description"), color.alias("color"), fields.alias("fields"),
        footer.alias("footer"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), author.alias("author"),
    )
    return df.select("id", "category", F.to_json(body).alias("message"))


def write_messages(messages: DataFrame, path: str) -> None:
    """Messages as text lines, one folder a category."""
    messages.select("category", F.col("message").alias("value")).write.mode("append").partitionBy("category").text(path)
