"""Groups of linked rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.session import checkpointed


def join(parent: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
    """Joins the groups of linked places; ``parent`` has each place's smallest one, before and after."""
    while len(r):
        x, y = parent[r], parent[c]
        r, c = r[x != y], c[x != y]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _joined(batches):
    """(node, label) of all ends of links (x, y), which one task holds."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        x, y = (np.concatenate(side) for side in zip(*got, strict=True))
        ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        parent = np.arange(len(ids))
        join(parent, at[: len(x)], at[len(x) :])
        for i in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(ids[parent[i : i + 100_000]])], ["node", "label"])


def components(links: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b", node: str = "node", rounds: int = 50, at_once: int = 0) -> DataFrame:
    """(node, group): the smallest node that links reach.  Labels fall to the smallest neighbour's, then jump to that label's own
    label, so rounds grow with the logarithm of a path; each is one aggregation, and no node's neighbours are collected.
    Labels are checkpointed each round, so that neither plans nor what a lost executor costs grow.  Up to ``at_once`` links between
    long integers are joined by one task instead, which saves the rounds; the groups are the same."""
    if at_once:
        links = checkpointed(links.select(F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b)))
        if links.count() <= at_once:
            labels = links.repartition(1).mapInArrow(_joined, "node long, label long").withColumnRenamed("node", node)
            return nodes.select(node).join(labels, node, "left").select(node, F.coalesce("label", node).alias("group"))
    both = checkpointed(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))))
    now = checkpointed(nodes.select(F.col(node).alias("node"), F.col(node).alias("label")))
    for _ in range(rounds):
        near = both.join(now.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("low"))
        low = now.join(near, now["node"] == near["x"], "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("low", "label")).alias("label"))
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = checkpointed(low.join(jump, "label", "left").select("node", "was", F.coalesce("further", "label").alias("label")))
        now = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return now.select(F.col("node").alias(node), F.col("label").alias("group"))
    raise RuntimeError("groups did not settle")
