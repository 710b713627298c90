"""Streams with state, cursors and once-only commits, over several micro-batches and restarts."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import state
from tidewheel.streaming import jobs, messages, stateful

NOW = dt.datetime(2026, 8, 1)


def in_files(rows, path, n, order=None):
    """``rows`` in n files that a stream reads one after the other."""
    at = F.ntile(n).over(order) if order is not None else F.floor(F.rand(5) * n) + 1
    rows = rows.withColumn("__n", at).persist()
    for i in range(1, n + 1):
        rows.filter(F.col("__n") == i).drop("__n").coalesce(1).write.mode("append").parquet(str(path))
    rows.unpersist()
    return str(path)


def events(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 7)), NOW + dt.timedelta(minutes=int(rng.integers(0, 300))), i, bool(rng.random() < 0.2), None if i % 5 == 0 else f"e{i}") for i in range(200)]
    return spark.createDataFrame(rows, "source_id long, ts timestamp, seq long, ok boolean, error string")


def key(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_health_in_any_order(spark, tmp_path):
    """Three batches in random order and a restart from the checkpoint: as the batch fold."""
    rows = events(spark)
    path = in_files(rows.filter("seq < 150"), tmp_path / "in", 3)
    run = lambda: jobs.drained(stateful.source_health(jobs.read(spark, path, rows.schema, files_per_batch=1)), "h", mode="update", keys=["source_id"], base=f"{tmp_path}/h")
    assert key(run().collect()) == key(state.fold_health(rows.filter("seq < 150")).collect())
    in_files(rows.filter("seq >= 150"), tmp_path / "in", 2)
    assert key(run().collect()) == key(state.fold_health(rows).collect())


def test_retries_start_from_known_counts(spark, tmp_path):
    rows = events(spark).selectExpr("source_id AS raw_item_id", "ts", "seq", "seq % 17 = 0 AS permanent", "error AS reason")
    path = in_files(rows, tmp_path / "in", 3)
    known = spark.createDataFrame([(1, 50, "old"), (99, 1, "old")], "raw_item_id long, attempts long, reason string")
    got = jobs.drained(stateful.retry_counts(jobs.read(spark, path, rows.schema, files_per_batch=1), max_attempts=60, known=known), "r", mode="update", keys=["raw_item_id"])
    n = {r[0]: r[1] for r in rows.groupBy("raw_item_id").count().collect()}
    last = {r.raw_item_id: r.x for r in rows.groupBy("raw_item_id").agg(F.max(F.struct("ts", "seq", "permanent", "reason")).alias("x")).collect()}
    found = {r.raw_item_id: r for r in got.collect()}
    assert set(found) >= set(n)
    for i in n:
        total = n[i] + (50 if i == 1 else 0)
        assert (found[i].attempts, found[i].reason, found[i].dead) == (total, last[i].reason, last[i].permanent or total >= 60)
        assert sum(int(x.rpartition(":")[2]) for x in found[i].reasons.split(",")) == total


def test_leases_end_by_event_time(spark, tmp_path):
    at = lambda m: NOW + dt.timedelta(minutes=m)
    rows = [(1, at(0), "claimed"), (2, at(1), "claimed"), (2, at(5), "sent"), (3, at(2), "claimed"), (3, at(30), "sent"), (4, at(40), "claimed"), (5, at(3), "claimed"), (5, at(10), "failed"), (5, at(11), "claimed"), (6, at(90), "claimed")]
    rows = spark.createDataFrame(rows, "dispatch_id long, ts timestamp, event string")
    from pyspark.sql import Window

    path = in_files(rows, tmp_path / "in", 3, Window.orderBy("ts"))
    got = jobs.drained(stateful.lease_expiry(jobs.read(spark, path, rows.schema, files_per_batch=1)), "l", mode="append")
    want = {(1, "expired", at(15)), (3, "expired", at(17)), (4, "expired", at(55)), (5, "expired", at(26))} | {tuple(r)[:1] + (r.event, r.ts) for r in rows.collect()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_pull_goes_on_after_a_crash(spark, tmp_path):
    """Offsets are per-channel ids: nothing is lost or repeated when a batch fails, or when files come late."""
    land = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('c/', id % 3) AS channel", "id AS message_id", "concat('m', id) AS text").repartition(2).write.mode("append").partitionBy("channel").parquet(f"{tmp_path}/land")
    land(1, 40)
    store, fail = f"{tmp_path}/store", [False]

    def batch(df, n):
        df.write.mode("overwrite").parquet(f"{store}/batch={n}")
        if fail[0]:
            raise RuntimeError("killed")

    def run():
        messages.pulled(spark, f"{tmp_path}/land").writeStream.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()

    run()
    land(40, 70)
    fail[0] = True
    with pytest.raises(Exception, match="killed"):
        run()
    fail[0] = False
    land(70, 75)
    run()
    run()
    got = spark.read.parquet(store).select("channel", "message_id", "text").collect()
    assert sorted((r.message_id, r.channel, r.text) for r in got) == [(i, f"c/{i % 3}", f"m{i}") for i in range(1, 75)]


def test_a_batch_is_sent_once(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "concat('c', id % 2) AS category", "concat('text ', id) AS message")
    path = in_files(rows, tmp_path / "in", 2)
    out, schema = f"{tmp_path}/out", "id long, category string, message string"
    messages.send(jobs.read(spark, path, rows.schema, files_per_batch=1), out, f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert sorted(r.id for r in messages.sent_messages(spark, out, schema).collect()) == list(range(50))
    # the same batches again, as after a crash between the sink's commit and the stream's
    messages.send(jobs.read(spark, path, rows.schema, files_per_batch=1), out, f"{tmp_path}/cp2", available_now=True).awaitTermination()
    assert sorted(r.id for r in messages.sent_messages(spark, out, schema).collect()) == list(range(50))
    import pathlib

    parts = {p.name for p in pathlib.Path(out).glob("part-*")}
    listed = {f for p in pathlib.Path(out).glob("batch-*") for f in json.loads(p.read_text())}
    assert parts == listed
