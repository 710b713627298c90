"""State tables: upserts, attempt and health folds, cursors, channels, run audits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in local mode a temporary folder serves where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, outlives executors, and frees the shuffle files behind it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def upsert_raw_items(existing: DataFrame, new: DataFrame, *, as_of: Column) -> DataFrame:
    """By (source_id, external_id) the new payload (of several, that of the greatest ``seq``, then the greatest) wins and is stamped; attempt fields of known rows stay."""
    key = ["source_id", "external_id"]
    last = new.groupBy(*key).agg(F.max_by("raw_payload", F.struct("seq", "raw_payload")).alias("new_payload"))
    both = existing.join(last, key, "full_outer")
    fresh = F.col("new_payload").isNotNull()
    changed = {"raw_payload": F.coalesce("new_payload", "raw_payload"), "fetched_at": F.when(fresh, as_of).otherwise(F.col("fetched_at")), "attempts": F.coalesce("attempts", F.lit(0)), "permanently_rejected": F.coalesce("permanently_rejected", F.lit(False)), "id": F.coalesce("id", F.xxhash64(*key))}
    return both.withColumns({c: v for c, v in changed.items() if c in existing.columns}).select(existing.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Known rows stay as they are; a new key comes in once."""
    fresh = new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def fold_attempts(raw: DataFrame, attempts: DataFrame, *, max_attempts: int = 3) -> DataFrame:
    """Raw items after a log of attempts (raw_item_id, ts, seq, reason, permanent): the last one sets reason and rejection."""
    order = F.struct("ts", "seq")
    log = attempts.groupBy(F.col("raw_item_id").alias("id")).agg(F.count("*").alias("n"), F.max("ts").alias("at"), F.max_by("reason", order).alias("why"), F.max_by("permanent", order).alias("final"))
    df = raw.join(log, "id", "left")
    total = F.col("attempts") + F.coalesce("n", F.lit(0))
    seen = F.col("n").isNotNull()
    return df.withColumns({
        "permanently_rejected": F.when(seen, F.col("final") | (total >= max_attempts)).otherwise(F.col("permanently_rejected")),
        "last_attempted_at": F.when(seen, F.col("at")).otherwise(F.col("last_attempted_at")),
        "last_reject_reason": F.when(seen, F.col("why")).otherwise(F.col("last_reject_reason")),
        "attempts": total,
    }).select(raw.columns)


def run_audit(outcomes: DataFrame, *, as_of: Column) -> DataFrame:
    """One row: status (success without errors, else partial) and counters as JSON."""
    names = ["fetched", "no_url", "prefiltered", "rejected", "dup", "written", "errors"]
    count = lambda n: F.count("*") if n == "fetched" else F.count_if(F.col("outcome") == ("error" if n == "errors" else n))
    row = outcomes.agg(*[count(n).alias(n) for n in names])
    return row.select(as_of.alias("finished_at"), F.when(F.col("errors") == 0, "success").otherwise("partial").alias("status"), F.to_json(F.struct(*names)).alias("stats"))


def fold_health(events: DataFrame) -> DataFrame:
    """Events (source_id, ts, seq, ok, error) -> last success and error, and failures since the last success.

    Aggregates only: the last success of each source, then the failures after it.
    """
    order = F.struct("ts", "seq")
    last = events.groupBy("source_id").agg(F.max(F.when(F.col("ok"), order)).alias("good"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_error"), F.max_by(F.coalesce("error", F.lit("unknown error")), F.when(~F.col("ok"), order)).alias("last_error_message"))
    failed = events.filter("not ok").join(last.select("source_id", "good"), "source_id").filter(F.col("good").isNull() | (order > F.col("good"))).groupBy("source_id").agg(F.count("*").alias("n"))
    return last.join(failed, "source_id", "left").select("source_id", "last_success", "last_error", F.when(F.col("last_error").isNotNull(), F.col("last_error_message")).alias("last_error_message"), F.coalesce("n", F.lit(0)).alias("consecutive_failures"))


def advance_cursors(cursors: DataFrame, messages: DataFrame) -> DataFrame:
    """Each channel's cursor moves to the largest processed id, never back."""
    top = messages.groupBy("channel").agg(F.max("message_id").alias("top"))
    return cursors.join(top, "channel", "full_outer").select("channel", F.greatest("last_message_id", "top").alias("last_message_id"))


def register_channels(existing: DataFrame, found: DataFrame) -> DataFrame:
    return insert_ignore(existing, found.withColumn("status", F.lit("new")), ["channel_username"])


def approve(channels: DataFrame, ids: DataFrame) -> DataFrame:
    """Only new channels become approved."""
    picked = ids.select("id").distinct().withColumn("__picked", F.lit(True))
    return channels.join(picked, "id", "left").withColumn("status", F.when((F.col("status") == "new") & F.col("__picked"), "approved").otherwise(F.col("status"))).select(channels.columns)


def list_channels(channels: DataFrame, status: str | None = None, *, limit: int | None = None) -> DataFrame:
    df = channels if status is None else channels.filter(F.col("status") == status)
    df = df.orderBy(F.desc("id"))
    return df.limit(limit) if limit is not None else df


def apply_outcomes(dispatches: DataFrame, outcomes: DataFrame, *, as_of: Column) -> DataFrame:
    """Outcomes (id, status, error, meta) of sends: sent_at only when sent; attempts stay."""
    new = outcomes.select("id", F.col("status").alias("__status"), F.col("error").alias("__error"), F.col("meta").alias("__meta"))
    seen = F.col("__status").isNotNull()
    df = dispatches.join(new, "id", "left")
    return df.withColumns({
        "status": F.coalesce("__status", "status"),
        "last_error": F.when(seen, F.col("__error")).otherwise(F.col("last_error")),
        "message_meta": F.when(seen, F.coalesce("__meta", F.lit("{}"))).otherwise(F.col("message_meta")),
        "sent_at": F.when(F.col("__status") == "sent", as_of).otherwise(F.col("sent_at")),
    }).select(dispatches.columns)


def failures_since_success(events: DataFrame) -> DataFrame:
    """Events with the number of failures up to each one since the success before it."""
    w = W.partitionBy("source_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    spells = events.withColumn("spell", F.count_if("ok").over(w))
    return spells.withColumn("failures", F.count_if(~F.col("ok")).over(W.partitionBy("source_id", "spell").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)))
