"""Streams: upserting ingest, delta pull, repeat suppression, daily counts, health and retry folds, lease expiry.

Each takes a source folder, a sink and a checkpoint; with ``available_now`` it drains what is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.state import advance_cursors, scratch, upsert_raw_items
from .stateful import PROVIDER, lease_expiry, retry_counts, source_health

__all__ = ["Table", "daily_counts", "drained", "ingest", "lease_expiry", "pull", "read", "retry_counts", "source_health", "suppress_repeats"]


def read(spark: SparkSession, source: str, schema, *, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(source)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


class Table:
    """A Parquet table that micro-batches upsert: a version holds only the parts (by hash of ``keys``) that its batch touched.

    Of each part the newest complete version is read. Doing a version twice gives the same; parts that a newer
    version before the last one holds are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema, *, keys: list[str], parts: int = 16):
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path.rstrip("/"), schema, keys, parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _newest(self, before: int | None) -> dict[int, int]:
        """The newest complete version of each part."""
        found: dict[int, int] = {}
        for v in sorted(int(n[1:]) for n in self._names(self.path) if n.startswith("v")):
            names = self._names(f"{self.path}/v{v}") if before is None or v < before else []
            if "_SUCCESS" in names:
                found |= {int(n.removeprefix("__part=")): v for n in names if n.startswith("__part=")}
        return found

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        have = {p: v for p, v in self._newest(before).items() if parts is None or p in parts}
        paths = [f"{self.path}/v{v}/__part={p}" for p, v in have.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, make: Callable[[DataFrame], DataFrame], touched: DataFrame, version: int) -> None:
        """Version ``version``: the parts that hold a key of ``touched``, made anew from what they were before it."""
        parts = [r[0] for r in touched.select(self._part()).distinct().collect()]
        made = make(self.read(before=version, parts=parts)).withColumn("__part", self._part())
        made.repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{self.path}/v{version}")
        keep = self._newest(version)
        for v in {int(n[1:]) for n in self._names(self.path) if n.startswith("v")}:
            for name in self._names(f"{self.path}/v{v}") if v < version else []:
                if name.startswith("__part=") and keep.get(int(name.removeprefix("__part=")), v) > v:
                    fs, where = self._fs(f"{self.path}/v{v}/{name}")
                    fs.delete(where, True)


def ingest(spark: SparkSession, source: str, table: Table, checkpoint: str, *, schema, files_per_batch: int = 100, available_now: bool = False) -> StreamingQuery:
    """Raw items (source_id, external_id, raw_payload, seq) are upserted batch by batch; ``table`` has those keys."""

    def batch(df: DataFrame, n: int) -> None:
        table.replace(lambda old: upsert_raw_items(old, df, as_of=F.current_timestamp()), df, n)

    return _start(read(spark, source, schema, files_per_batch=files_per_batch).writeStream.foreachBatch(batch), checkpoint, available_now)


def pull(spark: SparkSession, source: str, sink: str, cursors: Table, checkpoint: str, *, schema, available_now: bool = False) -> StreamingQuery:
    """Messages above their channel's cursor are stored; the cursor moves after they are."""

    def batch(df: DataFrame, n: int) -> None:
        known = cursors.read(before=n)
        new = df.join(known, "channel", "left").filter(F.col("message_id") > F.coalesce("last_message_id", F.lit(0))).select(df.columns).dropDuplicates(["channel", "message_id"])
        new.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={n}")
        cursors.replace(lambda old: advance_cursors(old, df), df, n)

    return _start(read(spark, source, schema).writeStream.foreachBatch(batch), checkpoint, available_now)


def suppress_repeats(events: DataFrame, *, keys: list[str], time_col: str, within: str = "14 days") -> DataFrame:
    """The first row of a key in each window; keys are forgotten after it."""
    return events.withWatermark(time_col, within).dropDuplicatesWithinWatermark(keys)


def daily_counts(events: DataFrame, *, time_col: str, late: str = "1 day") -> DataFrame:
    """Rows of each UTC day; rows later than the watermark are dropped."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def drained(df: DataFrame, name: str, *, mode: str, keys: list[str] | None = None, base: str | None = None) -> DataFrame:
    """What a stream gives until its source is empty, as files in the shared folder (or under ``base``, to go on there later): all rows (append),
    the last batch's (complete), or the last row of each of ``keys`` (update). State is kept in RocksDB."""
    spark = df.sparkSession
    base = base or scratch(spark, name)

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/__batch={n}")

    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    fields = StructType([*df.schema.fields, StructField("__batch", LongType())])
    rows = spark.read.schema(fields).parquet(f"{base}/rows")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("__batch").alias("__batch"))), "__batch", "left_semi")  # one row
    if mode == "update":
        rows = rows.groupBy(*keys).agg(*[F.max_by(c, "__batch").alias(c) for c in df.columns if c not in keys])
    return rows.select(df.columns)
