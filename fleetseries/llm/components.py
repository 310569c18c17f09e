"""Connected components of a link table, by min-label propagation with shortcuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseries.session import drop_table, write_table

#: Links (16 bytes each) that a task holds at a time.
TASK_LINKS = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node with the least node that the given links connect it to; fewer than nodes."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    top = np.arange(len(nodes))
    while True:
        new = top.copy()
        low = np.minimum(top[x], top[y])
        # a node's top takes the least label too, so that chains shorten by doubling
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, top[end], low)
        new = new[new]
        if (new == top).all():
            break
        top = new
    own = np.flatnonzero(top < np.arange(len(top)))
    return nodes[top[own]], nodes[own]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What connects the same nodes as the links of a task: stars, as few as its nodes."""
    a = b = np.empty(0, np.int64)
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return stars(*(np.concatenate([x, *[h.column(c).to_numpy() for h in held]]) for x, c in ((a, "a"), (b, "b"))))

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if len(a) + size >= TASK_LINKS:
            a, b = joined()
            held, size = [], 0
            if 2 * len(a) >= TASK_LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a = b = np.empty(0, np.int64)
    a, b = joined()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def connected(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of ``links`` (a, b): label is the smallest node of its component.

    Tasks first replace their links by stars, so a group whose members are
    linked many times over joins no more rows than it has members in a task.
    Each round takes the least label among a node's neighbours and then the
    label of that label, so chains shorten by doubling; it is written to the
    shared folder, which cuts the lineage. Nothing is collected but a count.
    """
    given = write_table(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"), "cc-links")
    tasks = max(1, -(-given.count() // TASK_LINKS))
    few = write_table(given.repartition(tasks).mapInArrow(_stars, "a long, b long"), "cc-stars")
    edges = write_table(few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = write_table(labels, "cc-labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("low")
        )
        up = labels.select(F.col("node").alias("__up"), F.col("label").alias("top"))
        stepped = low.join(up, low["low"] == up["__up"], "left").select(
            "node", "was", F.least("low", F.coalesce("top", "low")).alias("label")
        )
        stepped = write_table(stepped, "cc-labels")
        drop_table(labels)
        labels = stepped.select("node", "label")
        if not stepped.where("label <> was").limit(1).count():
            for table in (given, few, edges):
                drop_table(table)
            return labels
