"""The given tables in the roles that the jobs expect, in Spark and (``VIEWS``) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state

AS_OF = "1998-08-02 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS raw_item_id", "concat('Order ', o_orderkey % 501, ' of ', o_orderpriority) AS title", "o_orderpriority AS category",
        "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'live' ELSE 'unconfirmed' END AS verification_status", "o_orderkey % 10 <> 0 AS is_active", "CAST(o_orderdate AS timestamp) AS first_seen", "o_totalprice AS value",
        "CAST(o_orderdate AS timestamp) + INTERVAL 365 DAYS AS expires_at", "concat('handle', o_custkey % 50) AS author_handle", "CAST(NULL AS string) AS raw",
    )


def dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")).alias("d"))
    rows = first.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    hours = "make_dt_interval(0, CAST(d.l_quantity AS int))"
    return rows.selectExpr(
        "l_orderkey AS id", "l_orderkey AS offer_id", "'discord' AS channel", "CASE d.l_returnflag WHEN 'A' THEN 'sent' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status", "CAST(l_orderkey % 25 AS int) AS attempts", "CAST(NULL AS string) AS last_error",
        "CAST(NULL AS string) AS message_meta", f"CASE WHEN l_orderkey % 3 = 0 THEN CAST(o_orderdate AS timestamp) + {hours} END AS claimed_at", f"CASE WHEN d.l_returnflag = 'A' THEN CAST(o_orderdate AS timestamp) + {hours} END AS sent_at",
        "CAST(o_orderdate AS timestamp) AS created_at",
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "CAST(c_nationkey AS long) AS source_id", "CAST(c_custkey AS string) AS external_id", "CAST(NULL AS string) AS raw_payload", "TIMESTAMP '1998-01-01' + make_dt_interval(0, CAST(c_custkey % 5010 AS int)) AS fetched_at",
        "CAST(c_custkey % 4 AS int) AS attempts", "CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '1998-01-02' + make_dt_interval(0, CAST(c_custkey % 5010 AS int)) END AS last_attempted_at",
        "CASE c_custkey % 4 WHEN 1 THEN 'prefilter:too_short' WHEN 2 THEN 'llm_rejected' WHEN 3 THEN 'dup:url' END AS last_reject_reason", "c_custkey % 7 = 0 AS permanently_rejected",
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS long) AS id", "n_name AS name", "'web' AS kind", "n_nationkey % 5 <> 0 AS enabled")


def health_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS source_id", "CAST(ts AS timestamp) AS ts", "event_id AS seq", "event_id % 3 = 0 AS ok", "concat('error ', event_type) AS error")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id % 1000 + 1 AS raw_item_id", "CAST(ts AS timestamp) AS ts", "event_id AS seq", "event_type AS reason", "event_id % 11 = 0 AS permanent")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS string) AS channel", "turn AS message_id", "CAST(NULL AS string) AS date", "text", "CAST(NULL AS array<string>) AS entity_urls", "CAST(NULL AS long) AS views", "CAST(NULL AS long) AS forwards")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt over all cores; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def posts(spark: SparkSession, sf_dir: str, *what) -> DataFrame:
    """Documents with a URL lent from the pages: their text, or only ``what`` is made of it before the join."""
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "url")
    n = pages.count()
    docs = spread(table(spark, sf_dir, "documents")) if what else table(spark, sf_dir, "documents")
    what = what or ("text",)
    made = docs.select("doc_id", "source", (F.col("doc_id") % n).alias("page_id"), *what)
    return made.join(pages, "page_id").select("doc_id", *[c for c in made.columns if c not in ("doc_id", "page_id")], "url")


def landed(df: DataFrame, name: str, by: str, *, files: int = 3, path: str | None = None) -> str:
    """``df`` in some files in order of ``by``, one after the other as a feed would bring them; a stream takes a file a batch."""
    path = path or state.scratch(df.sparkSession, name)
    share = [i / files for i in range(1, files)]
    cuts = df.select(F.percentile_approx(by, share)).first()[0] or []
    part = sum((F.when(F.col(by) > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(files):
        df.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    return path


VIEWS = """WITH offers AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS raw_item_id, 'Order ' || (o_orderkey % 501) || ' of ' || o_orderpriority AS title, o_orderpriority AS category,
  CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'live' ELSE 'unconfirmed' END AS verification_status, o_orderkey % 10 <> 0 AS is_active, CAST(o_orderdate AS timestamp) AS first_seen, o_totalprice AS value,
  CAST(o_orderdate AS timestamp) + INTERVAL 365 DAY AS expires_at FROM orders),
first_line AS (SELECT l_orderkey, min({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_quantity, 'e': l_returnflag}) AS d FROM lineitem GROUP BY l_orderkey),
dispatches AS (SELECT l_orderkey AS id, l_orderkey AS offer_id, CASE d.e WHEN 'A' THEN 'sent' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status, CAST(l_orderkey % 25 AS int) AS attempts,
  CASE WHEN l_orderkey % 3 = 0 THEN CAST(o_orderdate AS timestamp) + to_hours(CAST(d.d AS bigint)) END AS claimed_at, CASE WHEN d.e = 'A' THEN CAST(o_orderdate AS timestamp) + to_hours(CAST(d.d AS bigint)) END AS sent_at, CAST(o_orderdate AS timestamp) AS created_at
  FROM first_line JOIN orders ON l_orderkey = o_orderkey),
raw_items AS (SELECT c_custkey AS id, CAST(c_nationkey AS bigint) AS source_id, TIMESTAMP '1998-01-01' + to_hours(CAST(c_custkey % 5010 AS bigint)) AS fetched_at, CAST(c_custkey % 4 AS int) AS attempts,
  CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '1998-01-02' + to_hours(CAST(c_custkey % 5010 AS bigint)) END AS last_attempted_at, CASE c_custkey % 4 WHEN 1 THEN 'prefilter:too_short' WHEN 2 THEN 'llm_rejected' WHEN 3 THEN 'dup:url' END AS last_reject_reason,
  c_custkey % 7 = 0 AS permanently_rejected FROM customer),
sources AS (SELECT CAST(n_nationkey AS bigint) AS id, n_name AS name, n_nationkey % 5 <> 0 AS enabled FROM nation),
health AS (SELECT user_id AS source_id, CAST(ts AS timestamp) AS ts, event_id AS seq, event_id % 3 = 0 AS ok, 'error ' || event_type AS error FROM events),
tries AS (SELECT event_id % 1000 + 1 AS raw_item_id, CAST(ts AS timestamp) AS ts, event_id AS seq, event_type AS reason, event_id % 11 = 0 AS permanent FROM events),
posts AS (SELECT doc_id, text, source, url FROM documents JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)),
sendable AS (SELECT * FROM offers WHERE is_active AND verification_status IN ('verified', 'live')),
state AS (SELECT r.*, EXISTS (SELECT 1 FROM offers o WHERE o.raw_item_id = r.id) AS has_offer FROM raw_items r)
"""
