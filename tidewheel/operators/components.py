"""Connected components by contraction: rounds over all links while they are many, the rest in one task of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import written


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links a-b, and the least node that each one reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)  # roots take the least root of a link
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _all_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        nodes, label = least_labels(*[np.concatenate(x) for x in zip(*parts)])
        yield pa.record_batch([pa.array(nodes), pa.array(label)], ["node", "label"])


def connected_components(links: DataFrame, *, in_one_task: int = 2_000_000) -> DataFrame:
    """Links (a, b: long) -> node, label: the least node that it reaches. Nodes without a link to another are not returned.

    A round gives each node the least of itself and its neighbours, and that one's in turn; nodes of one label
    become one and links within it go, so links fall fast, long chains' too. Once at most ``in_one_task`` links are
    left, one task ends the work (32 MB of numbers by default).
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    steps: list[DataFrame] = []
    while edges.count() > in_one_task:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = written(near.join(up, "label").select("node", F.col("up").alias("label")), "labels")
        steps.append(step)
        x, y = (step.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b"))
        moved = edges.join(x, "a").join(y, "b").select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b"))
        edges = written(moved.filter("a < b").distinct(), "links")
    labels = edges.coalesce(1).mapInArrow(_all_links, "node long, label long")
    for step in reversed(steps):
        last = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = step.join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return labels
