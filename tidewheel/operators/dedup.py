"""Duplicate gates: URL, title within a category and a time window, vectors; and the greedy resolution over all three.

An item is a duplicate only of an accepted one, so the result is the lexicographically first
maximal independent set in position order. Items that no chain of shared keys or near vectors joins
do not depend on each other: connected components are found first, each one of bounded size is resolved in
order by one task, and only larger ones go in rounds of key minima over their open rows, until these are few. Equal vectors are a
key like a URL; nearness is a relation of distinct vectors, so copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.offers import sha256_hex
from .components import connected_components
from .state import scratch, written
from .vectors import near_classes, semantic_pairs, vector_classes

__all__ = ["dedup", "greedy", "recent", "semantic_pairs", "title_gate", "url_gate"]


def recent(offers: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return offers.filter(F.col("first_seen") > as_of - F.make_interval(days=F.lit(days)))


def url_gate(candidates: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Candidates (id, canonical_url) whose URL is known: id, existing_offer_id (the least)."""
    known = fingerprints.groupBy("url_hash").agg(F.min("offer_id").alias("existing_offer_id"))
    return candidates.select("id", sha256_hex(F.col("canonical_url")).alias("url_hash")).join(known, "url_hash").select("id", "existing_offer_id")


def title_gate(candidates: DataFrame, fingerprints: DataFrame, offers: DataFrame, *, as_of: Column, days: int = 90) -> DataFrame:
    """Candidates (id, title, category) whose title is known in the category and window; the oldest offer is blamed."""
    live = recent(offers, as_of, days).select(F.col("id").alias("offer_id"), "category", "first_seen")
    known = fingerprints.select("offer_id", "title_hash").join(live, "offer_id").groupBy("title_hash", "category").agg(F.min_by("offer_id", F.struct("first_seen", "offer_id")).alias("existing_offer_id"))
    own = candidates.filter("coalesce(title, '') <> '' and coalesce(category, '') <> ''").select("id", "category", sha256_hex(F.lower("title")).alias("title_hash"))
    return own.join(known, ["title_hash", "category"]).select("id", "existing_offer_id")


KEYS = ("url_key", "title_key", "vec")
RESOLVED = "id long, position long, accepted boolean, basis string, blame long"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gates, row by row in order of position, within each component; rows come sorted by component."""
    label, taken, near = None, {}, {}
    for batch in batches:
        out = []
        for row in batch.select(["label", "id", "position", "url_key", "title_key", "vec", "near"]).to_pylist():
            if row["label"] != label:
                label, taken, near = row["label"], {k: {} for k in KEYS}, {}
            position, vec = row["position"], row["vec"]
            if row["near"]:
                near[vec] = row["near"]
            url, title = (taken[k].get(row[k]) for k in KEYS[:2])
            semantic = min((taken["vec"][c] for c in (vec, *near.get(vec, ())) if c in taken["vec"]), default=None) if vec is not None else None
            basis = None if position < 0 else "url" if url is not None else "title" if title is not None else "semantic" if semantic is not None else None
            if basis is None:
                for k in KEYS:
                    if row[k] is not None:
                        taken[k].setdefault(row[k], position)
            out.append((row["id"], position, basis is None, basis, {"url": url, "title": title, "semantic": semantic}.get(basis)))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()))], [c.split()[0] for c in RESOLVED.split(", ")]) if out else pa.record_batch([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64())], [c.split()[0] for c in RESOLVED.split(", ")])


def _deciding(taken: DataFrame, left: DataFrame, near: DataFrame) -> DataFrame:
    """The open rows, and of the accepted ones the first of each key and near class that they have."""
    columns = left.columns
    around = left.select(F.col("vec").alias("a")).distinct().join(near, "a").select(F.col("b").alias("vec")).distinct()
    parts = [left]
    for key, wanted in (*((k, left.select(k).distinct()) for k in KEYS[:2]), ("vec", around)):
        parts.append(taken.join(wanted, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*columns), "position").alias("row")).select("row.*"))
    return reduce(DataFrame.unionAll, parts).dropDuplicates(["position"])


def _in_rounds(rows: DataFrame, near: DataFrame, in_one_task: int) -> list[DataFrame]:
    """The same for components of any size: who is first by all keys and has no open earlier neighbour is accepted, who shares a key
    with an accepted earlier row is a duplicate, until none is open. Closed rows are not written again. Once what is open and what decides about it
    is few rows, it is resolved in order. Rounds add to the same two folders, so that a plan does not grow with them."""
    spark = rows.sparkSession
    state = rows.select("id", "position", *KEYS)
    folders = {"taken": scratch(spark, "taken"), "closed": scratch(spark, "closed")}

    def added(name: str, more: DataFrame) -> DataFrame:
        more.write.mode("append").parquet(folders[name])
        return spark.read.schema(more.schema).parquet(folders[name])

    known = state.filter("position < 0")
    taken = added("taken", known)
    closed = added("closed", known.select("id", "position", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("basis"), F.lit(None).cast("long").alias("blame")))
    left = written(state.filter("position >= 0"), "open")
    near = written(near.unionAll(rows.filter("vec is not null").select(F.col("vec").alias("a"), F.col("vec").alias("b"))).distinct(), "near")
    open_rows = left.count()
    while open_rows:
        if open_rows <= in_one_task // 2:
            rest = written(_deciding(taken, left, near), "rest")
            if rest.count() <= in_one_task:
                classes = rest.filter("vec is not null").select("vec").distinct()
                edges = near.filter("a < b").join(classes.withColumnRenamed("vec", "a"), "a", "left_semi").join(classes.withColumnRenamed("vec", "b"), "b", "left_semi")
                return [closed, greedy(rest, edges.select("a", "b"), in_one_task=in_one_task).join(left.select("position"), "position", "left_semi").select(closed.columns)]
        alive = taken.withColumn("accepted", F.lit(True)).unionAll(left.withColumn("accepted", F.lit(False)))

        def first(key: str) -> DataFrame:
            return alive.filter(f"{key} is not null").groupBy(key).agg(F.min_by(F.struct("position", "accepted"), "position").alias(f"{key}_first"))

        by_class = alive.filter("vec is not null").groupBy(F.col("vec").alias("b")).agg(F.min(F.when(F.col("accepted"), F.col("position"))).alias("t"), F.min(F.when(~F.col("accepted"), F.col("position"))).alias("o"))
        edge = near.join(by_class, "b").groupBy(F.col("a").alias("vec")).agg(F.min("t").alias("near_taken"), F.min("o").alias("near_open"))
        now = left.join(first("url_key"), "url_key", "left").join(first("title_key"), "title_key", "left").join(edge, "vec", "left")
        position = F.col("position")

        def hit(key: str) -> Column:
            f = F.col(f"{key}_first")
            return F.when(f["accepted"] & (f["position"] < position), f["position"])

        def lead(key: str) -> Column:
            return F.col(key).isNull() | (F.col(f"{key}_first")["position"] == position)

        near_hit, waits = F.when(F.col("near_taken") < position, F.col("near_taken")), F.coalesce(F.col("near_open") < position, F.lit(False))
        # an accepted row of the key may hide behind an earlier open one: such rows wait
        basis = F.when(hit("url_key").isNotNull(), "url").when(hit("title_key").isNotNull(), "title").when(near_hit.isNotNull(), "semantic")
        settled = F.coalesce(hit("url_key").isNotNull() | lead("url_key"), F.lit(False)) & F.coalesce(hit("title_key").isNotNull() | lead("title_key"), F.lit(False)) & ~waits
        accept = F.coalesce(lead("url_key") & lead("title_key"), F.lit(False)) & basis.isNull() & ~waits
        dup = basis.isNotNull() & (hit("url_key").isNotNull() | settled)
        step = written(now.select("id", "position", *KEYS, accept.alias("accepted"), F.when(dup, basis).alias("basis"), F.when(dup, F.coalesce(hit("url_key"), hit("title_key"), near_hit)).alias("blame"), (accept | dup).alias("closed")), "greedy")
        closed = added("closed", step.filter("closed").select(closed.columns))
        taken = added("taken", step.filter("accepted").select(taken.columns))
        left = step.filter("not closed").select("id", "position", *KEYS)
        before, open_rows = open_rows, left.count()
        if open_rows >= before:
            raise RuntimeError(f"a round of the greedy resolution settled none of {open_rows} open rows")
    return [closed]


def greedy(candidates: DataFrame, edges: DataFrame, *, in_one_task: int = 100_000) -> DataFrame:
    """Candidates (id, position, url_key, title_key, and vec: the class of its vector, or its own position without that column; keys may be null)
    and edges (a, b) of classes -> id, position, accepted, basis, blame: the accepted position that makes a row a duplicate.

    A class is named by the position of one of its rows. Positions below 0 are known rows: accepted from the start, not returned.
    Components of at most ``in_one_task`` rows are resolved in one task each.
    """
    if "vec" not in candidates.columns:
        candidates = candidates.withColumn("vec", F.col("position"))
    rows = written(candidates.select("id", "position", *KEYS), "candidates")
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "near-classes")

    def star(key: str) -> DataFrame:
        """Each row of a key by its first row."""
        keyed = rows.filter(f"{key} is not null").select(key, "position")
        return keyed.join(keyed.groupBy(key).agg(F.min("position").alias("a"), F.count("*").alias("n")).filter("n > 1"), key).select("a", F.col("position").alias("b"))

    stars = reduce(DataFrame.unionAll, [star(k) for k in KEYS])
    heads = rows.filter("vec is not null").groupBy("vec").agg(F.min("position").alias("head"))
    joined = edges.join(heads.withColumnsRenamed({"vec": "a", "head": "x"}), "a").join(heads.withColumnsRenamed({"vec": "b", "head": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = connected_components(stars.unionAll(joined)).withColumnRenamed("node", "position")
    marked = written(rows.join(labels, "position", "left"), "components")
    sizes = marked.filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    grouped = written(marked.join(sizes, "label", "left"), "sized")
    alone = grouped.filter("label is null").select("id", "position", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("basis"), F.lit(None).cast("long").alias("blame"))
    small = grouped.filter(F.col("n") <= in_one_task)
    # a class' neighbours go with the first of its rows
    around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("vec")).agg(F.collect_list("b").alias("near"))
    around = around.join(heads, "vec").select(F.col("head").alias("position"), "near")
    dealt = small.join(around, "position", "left").repartition("label").sortWithinPartitions("label", "position")
    parts = [alone, dealt.mapInArrow(_in_order, RESOLVED)]
    large = grouped.filter(F.col("n") > in_one_task)
    if not large.isEmpty():
        own = large.select("vec").distinct()
        parts += _in_rounds(large, edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(own.withColumnRenamed("vec", "a"), "a", "left_semi"), in_one_task)
    return reduce(DataFrame.unionAll, parts).filter("position >= 0")


def dedup(candidates: DataFrame, fingerprints: DataFrame, offers: DataFrame, *, as_of: Column, days: int = 90, threshold: float = 0.92) -> DataFrame:
    """Candidates (id, position, canonical_url, title, category, embedding) -> id, is_dup, basis, existing_offer_id, similarity.

    Known offers come first: their URLs count always, titles and vectors only within the window.
    existing_offer_id is the known offer's id or the accepted candidate's.
    """
    live = recent(offers, as_of, days).select(F.col("id").alias("offer_id"), "category", F.lit(True).alias("live"))
    old = fingerprints.join(live, "offer_id", "left")
    key = F.concat_ws(":", "title_hash", "category")
    known = old.select(F.col("offer_id").alias("id"), (-F.col("offer_id") - 1).alias("position"), F.col("url_hash").alias("url_key"), F.when(F.col("live"), key).alias("title_key"), F.when(F.col("live"), F.col("embedding")).alias("embedding"))
    titled = "coalesce(title, '') <> '' and coalesce(category, '') <> ''"
    fresh = candidates.select("id", F.col("position").cast("long").alias("position"), sha256_hex(F.col("canonical_url")).alias("url_key"), F.when(F.expr(titled), F.concat_ws(":", sha256_hex(F.lower("title")), F.col("category"))).alias("title_key"), "embedding")
    rows = written(known.union(fresh), "dedup")
    reps, members = vector_classes(rows.select(F.col("position").alias("id"), "embedding"))
    members = written(members.select(F.col("id").alias("position"), F.col("rep").alias("vec")), "members")
    pairs = written(near_classes(reps, threshold=threshold), "pairs")
    keyed = rows.drop("embedding").join(members, "position", "left")
    done = written(greedy(keyed, pairs.select("a", "b")), "resolved")
    # of several accepted neighbours the nearest is named; of a class the first accepted one
    kept = done.filter("accepted").select("position").union(known.select("position"))
    first = kept.join(members, "position").groupBy("vec").agg(F.min("position").alias("by"))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionAll(reps.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    close = both.join(first.withColumnRenamed("vec", "b"), "b").select(F.col("a").alias("vec"), "by", "similarity")
    wanted = done.filter("basis = 'semantic'").select("position").join(members, "position")
    near = wanted.join(close, "vec").filter("by < position").groupBy("position").agg(F.max_by(F.struct("by", "similarity"), F.struct("similarity", -F.col("by"))).alias("near"))
    semantic = F.col("basis") == "semantic"
    done = done.join(near, "position", "left").withColumn("blame", F.when(semantic, F.col("near.by")).otherwise(F.col("blame")))
    blamed = rows.select(F.col("position").alias("blame"), F.col("id").alias("existing_offer_id"))
    # of several known offers with the title the oldest is named
    oldest = title_gate(candidates, fingerprints, offers, as_of=as_of, days=days).withColumnRenamed("existing_offer_id", "oldest")
    out = done.join(blamed, "blame", "left").join(oldest, "id", "left")
    existing = F.when(F.col("basis") == "title", F.coalesce("oldest", "existing_offer_id")).otherwise(F.col("existing_offer_id"))
    return out.select("id", (~F.col("accepted")).alias("is_dup"), "basis", existing.alias("existing_offer_id"), F.when(semantic, F.round("near.similarity", 4)).alias("similarity"))
