"""Connected components of an edge table by repeated hooking and contraction, with no edge or label on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.shared import drop_staged, stage


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list and, for each, the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as a star around each component's smallest node: at most one edge a node."""
    if not len(a):
        return a, b
    nodes, root = roots(a, b)
    far = nodes != root
    return root[far], nodes[far]


def _shrink(batches):
    rows = 0
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        parts.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        rows += batch.num_rows
        if rows > 2_000_000:  # a bound on memory: what is left to join up is left to the rounds
            yield from _stars_of(parts)
            rows, parts = 0, []
    yield from _stars_of(parts)


def _stars_of(parts):
    if parts:
        a, b = stars(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to rows (node, root): root is the smallest node that node reaches, for every node that is not itself the smallest.

    Each round hooks every node to its smallest neighbour, jumps pointers and contracts the edges; a round at least
    halves the nodes of any component that is no star, and stars end in one. Aggregations are partial before they are
    shuffled and joins are of the kind that Spark splits when a node has very many edges. Rounds are cut by tables in
    the shared folder. Rows with null are no edges; self-links and repeated edges change nothing.
    """
    live = stage(edges.where("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(_shrink, "a long, b long"), "edges")
    parents: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        for _ in range(2):
            far = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
            up = up.join(far, "up", "left").select("node", F.coalesce("further", "up").alias("up"))
        up = stage(up.where("node <> up"), "hooks")
        a, b = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        moved = live.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        left = stage(moved.where("a <> b").distinct().mapInArrow(_shrink, "a long, b long"), "edges")
        drop_staged(live)
        if parents is None:
            parents = up
        else:
            onward = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
            joined = parents.join(onward, "up", "left").select("node", F.coalesce("further", "up").alias("up")).unionByName(up)
            merged = stage(joined, "labels")
            drop_staged(parents)
            drop_staged(up)
            parents = merged
        live = left
    drop_staged(live)
    if parents is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return parents.select("node", F.col("up").alias("root"))
