"""Shared plumbing: the shared work folder, written intermediates and null-safe ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id while rows are ordered and grouped; such rows come last.
NULL_ID = (1 << 63) - 1


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode a temporary one is set where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _MADE.append(f"{work_dir(spark)}/tidewheel-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def delete_scratch(spark: SparkSession) -> None:
    """Deletes what this process has written to the shared folder; results that still read it must be used up."""
    jvm = spark.sparkContext._jvm
    for path in _MADE:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.clear()


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt over all cores; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


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


def id_or_last(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def null_back(col: str) -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))
