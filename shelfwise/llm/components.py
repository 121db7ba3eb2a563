"""Connected components of a link table.

Rules for odd rows. A link with a null end links nothing and goes; repeated links and links of a node
to itself change nothing. Without links there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.lineage import discard, pin


class _Trees:
    """Trees over the nodes of a task; the root of a tree is its smallest node."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        path = []
        while (up := parent.get(node, node)) != node:
            path.append(node)
            node = up
        for passed in path:
            parent[passed] = node
        return node

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.root(a), self.root(b)))
        if low != high:
            self.parent[high] = low


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One link per node and task, to the smallest node of its tree."""
    trees = _Trees()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            trees.join(a, b)
    nodes = np.fromiter(trees.parent, dtype=np.int64, count=len(trees.parent))
    roots = np.array([trees.root(node) for node in nodes.tolist()], dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(roots), pa.array(nodes)], ["a", "b"])


def spanning_forest(links: DataFrame) -> DataFrame:
    """Links (a, b) with a < b of the same components, about one a node.

    Each task reduces its links to stars around the smallest node of each tree. Dealt by the other
    node, which has at most one link a task then, so that no node is hot, the stars are reduced again.
    """
    kept = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")
    )
    stars = kept.mapInArrow(_tree_links, "a long, b long")
    return stars.repartition("b").mapInArrow(_tree_links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of undirected links (a, b).

    The links become a spanning forest first. Then each round every node takes the least label of its
    neighbours, by a partial aggregate, and the label of its label, so chains halve. Labels are
    written to the shared folder after each round, and those of the round before deleted; the loop
    ends when no label changes.
    """
    forest = pin(spanning_forest(links), "forest")
    both = forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = pin(
        both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("component"), F.lit(True).alias("changed")
        ),
        "labels",
    )
    while True:
        old = labels.select("node", "component")
        around = both.join(old, both.b == old.node).groupBy("a").agg(F.min("component").alias("least"))
        taken = old.join(around, old.node == around.a).select(
            "node", F.least("component", "least").alias("next"), "component"
        )
        target = old.select(F.col("node").alias("target"), F.col("component").alias("further"))
        least = F.least("next", F.coalesce("further", "next"))
        jumped = taken.join(target, taken.next == target.target, "left").select(
            "node", least.alias("component"), (least < F.col("component")).alias("changed")
        )
        step = pin(jumped, "labels")
        discard(labels)
        labels = step
        if step.where("changed").isEmpty():
            discard(forest)
            return step.select("node", "component")
