"""Picking work: fair fetch, caps, batches, unseen pages, new messages, feeds for a dashboard."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def clamp_fraction(value) -> float:
    """0..1; anything that is no number gives a half."""
    try:
        return min(1.0, max(0.0, float(value)))
    except (TypeError, ValueError):
        return 0.5


def unprocessed(raw: DataFrame, sources: DataFrame, offers: DataFrame, *, source: str | None = None) -> DataFrame:
    """Items of enabled sources, not rejected, without an offer. ``sources`` is a small dimension."""
    live = sources.filter("enabled").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"))
    if source is not None:
        live = live.filter(F.col("source_name") == source)
    done = offers.select(F.col("raw_item_id").alias("id")).filter("id is not null").distinct()
    return raw.filter("not permanently_rejected").join(live, "source_id").join(done, "id", "left_anti")


def fetch_unprocessed(raw: DataFrame, sources: DataFrame, offers: DataFrame, *, limit: int, source: str | None = None, oldest_fraction=0.5) -> DataFrame:
    """The oldest part of a batch and, for the rest, the newest; an item once. Two top-k scans, no global sort."""
    pool = unprocessed(raw, sources, offers, source=source)
    old = int(limit * clamp_fraction(oldest_fraction))
    oldest = pool.orderBy("fetched_at", "id").limit(old)
    newest = pool.orderBy(F.desc("fetched_at"), F.desc("id")).limit(limit - old)
    return oldest.union(newest).dropDuplicates(["id"])


def cap_per_group(df: DataFrame, group: str, *order: str, per_group: int, total: int | None = None) -> DataFrame:
    """At most ``per_group`` rows of a group, and ``total`` of all, in feed order."""
    kept = df.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= per_group).drop("__n")
    return kept.orderBy(*order).limit(total) if total is not None else kept


def cap_sequential(df: DataFrame, *, run: str, order: str, tag: str, key: str, per_tag: int, total: int) -> DataFrame:
    """The exact feed loop of one run (a few hundred rows): a key met after its tag is full may still be taken by another tag."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, used, keep = set(), {}, []
        for i, (k, t) in enumerate(zip(*(pdf.sort_values(order, kind="stable")[c] for c in (key, tag)))):
            if len(keep) >= total:
                break
            if k in seen or used.get(t, 0) >= per_tag:
                continue
            seen.add(k)
            used[t] = used.get(t, 0) + 1
            keep.append(i)
        return pdf.sort_values(order, kind="stable").iloc[keep]

    return df.groupBy(run).applyInPandas(one, df.schema)


def batches(items: DataFrame, *, mode: str, order: str, size: int = 10) -> DataFrame:
    """Adds batch (from 0, within a mode) and position for a picked, small set of items."""
    n = F.row_number().over(W.partitionBy(mode).orderBy(order)) - 1
    return items.withColumn("batch", F.floor(n / size).cast("int")).withColumn("position", (n % size).cast("int"))


def filter_unseen(urls: DataFrame, raw: DataFrame, *, within_days: int = 14, as_of: Column) -> DataFrame:
    """URLs (source_id, url) that their source has not brought within the window; raw keys are 20 hex digits of the URL's hash."""
    recent = raw.filter(F.col("fetched_at") > as_of - F.make_interval(days=F.lit(within_days))).select("source_id", F.col("external_id").alias("__key")).distinct()
    return urls.withColumn("__key", F.substring(F.sha2("url", 256), 1, 20)).join(recent, ["source_id", "__key"], "left_anti").select(urls.columns)


def delta_pull(messages: DataFrame, cursors: DataFrame, *, limit: int = 50) -> DataFrame:
    """Of each channel the newest ``limit`` messages above its cursor, to be read in ascending order."""
    above = messages.join(cursors.select("channel", "last_message_id"), "channel", "left").filter(F.col("message_id") > F.coalesce("last_message_id", F.lit(0)))
    newest = W.partitionBy("channel").orderBy(F.desc("message_id"))
    return above.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= limit).drop("__n", "last_message_id")


def offers_feed(offers: DataFrame, raw: DataFrame, sources: DataFrame, *, q: str | None = None, category: str | None = None, status: str | None = None, availability: str = "active", limit: int = 100, as_of: Column) -> DataFrame:
    """Newest offers that match, with their source (offers without one stay). The cut comes before the joins."""
    df = offers
    if q:
        df = df.filter(F.col("title").ilike(f"%{q}%"))
    if category and category != "all":
        df = df.filter(F.col("category") == category)
    if status and status != "all":
        df = df.filter(F.col("verification_status") == status)
    gone = ~F.col("is_active") | F.coalesce(F.col("expires_at") < as_of, F.lit(False))
    df = df.filter(gone) if availability == "expired" else df.filter(F.col("is_active")) if availability == "active" else df
    top = df.orderBy(F.desc("first_seen"), F.desc("id")).limit(max(1, min(500, limit)))
    item = raw.select(F.col("id").alias("raw_item_id"), "source_id")
    source = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return top.join(item, "raw_item_id", "left").join(source, "source_id", "left")
