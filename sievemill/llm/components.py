"""Connected components by repeated contraction, in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written

#: Links that a task reduces to a forest at a time (some 100 MB).
HELD = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that links lead to from each)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links -> links of the same connections: each node of a task's links with the least one that it reaches by them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        nodes, least = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        leaf = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(least[leaf]), pa.array(nodes[leaf])], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) > HELD:
            yield flush()
    if held:
        yield flush()


def _reduced(edges: DataFrame) -> DataFrame:
    return written(edges.distinct().mapInArrow(_stars, "a bigint, b bigint"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of links (a, b); one label for each component, one of its nodes.

    Each round replaces the links that a task sees by stars of the same
    connections, maps every node to the least of itself and its neighbours (by
    value in the first round, then by a hash order that changes), and renames
    the links' ends; links within a name go.  The maps are composed.  Nodes
    without links, null ends and an empty table give no rows.
    """
    edges = _reduced(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    labels = None
    for turn in range(1_000):
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(turn)) if turn else c).alias("h"), c.alias("x"))  # noqa: B023, E731
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("least"))
        step = written(step.select(F.col("a").alias("node"), F.least(rank(F.col("a")), "least")["x"].alias("to")), "contraction")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            moved = labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left")
            labels = written(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        one = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
        two = one.join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b").where("a2 <> b2")
        left = _reduced(two.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")))
        discard(edges)
        edges = left
        if edges.isEmpty():
            return labels
    raise RuntimeError("the components did not close")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of `components` after more links: only names that the links join are contracted."""
    name = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    ends = links.join(name("a"), "a", "left").join(name("b"), "b", "left")
    new = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    moved = moved.select("node", F.coalesce("to", "label").alias("label"))
    return written(moved.unionByName(new.join(labels.select("node"), "node", "left_anti")), "labels")
