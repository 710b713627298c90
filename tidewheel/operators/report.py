"""Status, funnel, yield and latency reports: small aggregates over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def totals(offers: DataFrame) -> DataFrame:
    return offers.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Counts by a column, most first, then by key (statuses, categories, reasons)."""
    return df.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def with_state(raw: DataFrame, offers: DataFrame) -> DataFrame:
    """Raw items with has_offer; offers are reduced to their item ids first."""
    done = offers.select(F.col("raw_item_id").alias("id")).distinct().withColumn("has_offer", F.lit(True))
    return raw.join(done, "id", "left").withColumn("has_offer", F.coalesce("has_offer", F.lit(False)))


def item_counts(raw: DataFrame, offers: DataFrame) -> DataFrame:
    df = with_state(raw, offers)
    return df.agg(F.count("*").alias("total"), F.count_if("permanently_rejected").alias("rejected"), F.count_if(~F.col("permanently_rejected") & ~F.col("has_offer")).alias("unprocessed"))


def last_success(runs: DataFrame) -> DataFrame:
    end = F.coalesce("finished_at", "started_at")
    return runs.filter("status = 'success'").agg(F.max(end).alias("last_success"), F.max_by("id", F.struct(end, "id")).alias("run_id"))


def last_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def overview(offers: DataFrame, dispatches: DataFrame) -> DataFrame:
    good = offers.agg(F.count_if(F.col("is_active") & F.col("verification_status").isin("verified", "live")).alias("active_verified"))
    sent = dispatches.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "sent").alias("sent"))
    return good.withColumn("k", F.lit(1)).join(sent.withColumn("k", F.lit(1)), "k").drop("k")


def daily_counts(offers: DataFrame, *, as_of: Column, days: int = 7) -> DataFrame:
    """Offers of each of the last days (UTC), zero where none: counted first, then joined to the calendar."""
    today = F.to_date(as_of)
    per_day = offers.filter(F.to_date("first_seen") > F.date_sub(today, days)).groupBy(F.to_date("first_seen").alias("day")).agg(F.count("*").alias("n"))
    calendar = offers.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    return calendar.join(per_day, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def recent_reasons(raw: DataFrame, *, as_of: Column, minutes: int = 15) -> DataFrame:
    late = raw.filter(F.col("last_attempted_at") > as_of - F.make_interval(mins=F.lit(minutes))).filter("last_reject_reason is not null")
    return count_by(late, "last_reject_reason")


def table_counts(**tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def count_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("table_name", F.col("n").alias("before")).join(after.select("table_name", F.col("n").alias("after")), "table_name", "full_outer").withColumn("delta", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))


def with_share(counts: DataFrame, n: str = "n") -> DataFrame:
    """A small count table with each row's share of the total and of the largest."""
    whole = W.partitionBy()
    return counts.withColumn("share", F.round(F.col(n) / F.sum(n).over(whole), 6)).withColumn("bar", F.round(F.col(n) / F.greatest(F.lit(1), F.max(n).over(whole)), 6))


def funnel(raw: DataFrame, offers: DataFrame) -> DataFrame:
    """Items by stage: offer, rejected, untouched, retry; each in one."""
    stage = F.when(F.col("has_offer"), "offer").when(F.col("permanently_rejected"), "rejected").when(F.col("attempts") == 0, "untouched").otherwise("retry")
    return with_share(with_state(raw, offers).groupBy(stage.alias("stage")).agg(F.count("*").alias("n")))


def reject_reasons(raw: DataFrame) -> DataFrame:
    """Reasons by stage (what stands before the colon)."""
    return count_by(raw.filter("last_reject_reason is not null").withColumn("stage", F.split("last_reject_reason", ":")[0]).withColumn("reason", F.struct("stage", "last_reject_reason")), "reason").select("reason.stage", F.col("reason.last_reject_reason").alias("reason"), "n")


def yield_per_source(raw: DataFrame, offers: DataFrame, sources: DataFrame) -> DataFrame:
    """Items and offers of each source, reduced before the join with the names."""
    per = with_state(raw, offers).groupBy("source_id").agg(F.count("*").alias("raw"), F.count_if("has_offer").alias("offers"))
    dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return per.join(dim, "source_id").select("source_name", "raw", "offers", F.round(F.col("offers") / F.col("raw"), 6).alias("yield"))


def zero_yield(yields: DataFrame) -> DataFrame:
    return yields.filter("offers = 0").orderBy(F.desc("raw"), "source_name")


def sent_by_category(offers: DataFrame, dispatches: DataFrame) -> DataFrame:
    sent = dispatches.filter("status = 'sent'").select(F.col("offer_id").alias("id"))
    return with_share(offers.join(sent, "id").groupBy("category").agg(F.count("*").alias("n")))


def send_latency(offers: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Hours from first_seen to sent: median, 90th percentile, longest, and how many took over a day."""
    sent = dispatches.filter("status = 'sent'").select(F.col("offer_id").alias("id"), "sent_at")
    h = ((F.col("sent_at").cast("double") - F.col("first_seen").cast("double")) / 3600).alias("h")
    return offers.join(sent, "id").select(h).agg(F.count("*").alias("n"), F.round(F.percentile("h", 0.5), 6).alias("median_h"), F.round(F.percentile("h", 0.9), 6).alias("p90_h"), F.round(F.max("h"), 6).alias("max_h"), F.count_if(F.col("h") > 24).alias("over_a_day"))


def daily_sketches(offers: DataFrame, dispatches: DataFrame, *, k: int = 400, lg_k: int = 14) -> DataFrame:
    """A row for each day of sending and category, to be stored: n, a KLL sketch of hours from first_seen to sent, and an HLL sketch of handles.

    ``k`` and ``lg_k`` fix the error (ranks within about 1 %, distinct counts within about 1 %) and the size of a row, whatever the number of offers.
    """
    sent = dispatches.filter("status = 'sent'").select(F.col("offer_id").alias("id"), "sent_at")
    h = (F.col("sent_at").cast("double") - F.col("first_seen").cast("double")) / 3600
    rows = offers.join(sent, "id").select(F.to_date("sent_at").alias("day"), "category", h.alias("h"), "author_handle")
    return rows.groupBy("day", "category").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("h", k).alias("hours"), F.hll_sketch_agg("author_handle", lg_k).alias("handles"))


def from_sketches(daily: DataFrame, *, first: Column, last: Column) -> DataFrame:
    """From stored daily rows, for the days first..last: category, n, median_h, p90_h and handles; only the days' few rows are read."""
    merged = daily.filter(F.col("day").between(first, last)).groupBy("category").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("hours").alias("hours"), F.hll_sketch_estimate(F.hll_union_agg("handles")).alias("handles"))
    at = lambda q: F.kll_sketch_get_quantile_double("hours", F.lit(q))
    return merged.select("category", "n", at(0.5).alias("median_h"), at(0.9).alias("p90_h"), "handles")


def url_profile(urls: DataFrame, url_col: str = "url") -> DataFrame:
    slashes = F.length(url_col) - F.length(F.replace(F.col(url_col), F.lit("/"), F.lit("")))
    df = urls.select(F.length(url_col).alias("len"), slashes.alias("slashes"))
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in ("len", "slashes") for n, f in (("min", F.min), ("median", F.median), ("max", F.max))])


def ingest_vs_drain(raw: DataFrame) -> DataFrame:
    """Items that came and that were settled, by day."""
    came = raw.groupBy(F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("ingested"))
    done = raw.filter("last_attempted_at is not null").groupBy(F.to_date("last_attempted_at").alias("day")).agg(F.count("*").alias("drained"))
    return came.join(done, "day", "full_outer").select("day", F.coalesce("ingested", F.lit(0)).alias("ingested"), F.coalesce("drained", F.lit(0)).alias("drained"))


def recent_failures(dispatches: DataFrame, limit: int = 5) -> DataFrame:
    return dispatches.filter("status = 'failed'").select("id", "offer_id", "attempts", "last_error").orderBy(F.desc("id")).limit(limit)


def recent_runs(runs: DataFrame, limit: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def newest_offers(offers: DataFrame, limit: int = 6) -> DataFrame:
    return offers.orderBy(F.desc("first_seen"), F.desc("id")).limit(limit)


def cursors_by_update(cursors: DataFrame, sources: DataFrame) -> DataFrame:
    dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return cursors.join(dim, "source_id").orderBy(F.desc_nulls_last("updated_at"), "channel_username")


def source_list(sources: DataFrame) -> DataFrame:
    return sources.orderBy("name")


def category_list(sources: DataFrame) -> DataFrame:
    from ..functions.offers import hex_color, taxonomy

    return taxonomy(sources.sparkSession).select("position", "key", "emoji", hex_color(F.col("color")).alias("color"))
