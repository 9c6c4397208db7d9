"""Connected components of a graph of links, by large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opquality.llm.common import cut_counted, map_arrow, tasks_for

# A task joins its links whenever it holds so many.
LINKS_HELD = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links, and the least node that each can reach by them."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        left, right = label[x], label[y]
        if (left == right).all():
            return nodes, nodes[label]
        least = np.minimum(left, right)
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        while (label[label] != label).any():
            label = label[label]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as a label for each node, the least it can reach by them."""
    node, label = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= LINKS_HELD:
            node, label = least_labels(*(np.concatenate(x) for x in zip((node, label), *held)))
            held, size = [], 0
    if held:
        node, label = least_labels(*(np.concatenate(x) for x in zip((node, label), *held)))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])


def _to_smallest(links: DataFrame, larger_only: bool, tasks: int) -> DataFrame:
    """Ties a node's neighbours to the smallest node of them and itself: all that are
    larger than the node, or all that are smaller together with the node."""
    both = links if larger_only else links.where("a > b")
    if larger_only:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).coalesce(tasks)
    tied = both.join(least, "a").coalesce(tasks)
    if larger_only:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    return tied.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(tied.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Per node that has a link to another: node and label, the smallest
    node it can reach. Each task first joins its own links, which ends it when there are
    so few that one task reads them. Else stars go on, whose number of rounds grows with the
    logarithm of the longest path; no node's neighbours are gathered in one place."""
    at, count = cut_counted(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    joined = map_arrow(at, _joined, "node long, label long")
    if tasks_for(count) == 1:
        return joined
    at, count = cut_counted(joined.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).distinct())
    seen = None
    while True:
        # As many tasks as the links were read by; a round does not make them more than twice as many.
        tasks = tasks_for(count)
        at, count = cut_counted(_to_smallest(_to_smallest(at, True, tasks).coalesce(tasks), False, tasks).coalesce(tasks))
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == seen:
            break
        seen = now
    return at.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
