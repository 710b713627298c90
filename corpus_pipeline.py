"""The corpus pipeline: quality rules, near duplicates, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all of docs. Stages 1-4 return the columns
of documents; run() writes each stage's rows to the shared folder and reads them again.

Defined results: each row is a document of its own, so null and repeated ids are treated as all
others (a stage that takes rows out numbers them first). Of near duplicates the one of the least id stays;
among equal ids, and null ids (which come last), the first as numbered. Null, empty and wordless texts go with the
quality rules (under 50 words). Texts of any length are worked on whole. An empty table gives an empty result
from each stage. Other columns, whatever their names, go along unchanged as far as stage 4: stages that
make columns of their own carry the input row in a struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import spread, written
from tidewheel.llm.decontam import contaminated_passages
from tidewheel.llm.jaccard import near_duplicate_components
from tidewheel.llm.packing import pack_sequences
from tidewheel.llm.quality import keep_quality
from tidewheel.llm.secrets import redact, secret_spans


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(id, row): ``docs`` in a struct with a number for each row, written so that it stays the same."""
    return written(docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")), name)


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The input rows but those of ``ids``; the side of texts is not sorted for it."""
    return rows.join(ids.hint("shuffle_hash"), "id", "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the least id's (a null id comes last), and all that are in none."""
    rows = numbered(docs, "near_duplicates_in")
    found = near_duplicate_components(rows.select("id", "row.text"), id_col="id", text_col="text")
    groups = written(found.select("id", "component_id").join(rows.select("id", "row.doc_id"), "id"), "groups")
    first = groups.groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))["id"].alias("first")).filter("n > 1")
    return without(rows, groups.join(first, "component_id").filter("id <> first").select("id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = numbered(docs, "decontamination_in")
    return without(rows, contaminated_passages(rows.select("id", "row.text"), benchmark, id_col="id", text_col="text").select("id").distinct())


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark, n_chars kept in step."""
    rows = docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    found = secret_spans(rows, keep=("row",))
    text = redact(F.col("row")["text"], F.col("all_spans"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("all_spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_sequences(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("packing", packing),
]
#: Edit verification and tokenisation are not for SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
