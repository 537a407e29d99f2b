"""Connected components of a large edge table by contraction.

Each task first joins the edges it holds; what is left is contracted in rounds:
every node points to its least neighbour, pointers are followed a few steps,
and edges are redrawn between what the nodes point to.  A round at least halves
the nodes of every component.  Only counts of rows reach the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.sources.storage import write_shared

JUMPS = 2


def _stars(batches):
    """Edges of one task joined: each node with the least node that the task's edges lead to."""
    parent: dict = {}

    def root(node):
        while (up := parent.setdefault(node, node)) != node:
            parent[node] = parent[up]
            node = parent[node]
        return node

    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(node, top) for node in parent if (top := root(node)) != node]
    if pairs:
        a, b = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) names; the root is the least node of its component."""
    kind = edges.schema["a"].dataType.simpleString()
    edges = write_shared(edges.select("a", "b").where("a <> b").mapInArrow(_stars, f"a {kind}, b {kind}"), "stars")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    steps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        points = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        points = points.select("node", F.least("node", "least").alias("up"))
        for _ in range(JUMPS):
            onward = points.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
            points = points.join(onward, F.col("up") == F.col("_node")).select("node", F.col("_up").alias("up"))
        points = write_shared(points, "pointers")
        steps.append(points)
        a = points.select(F.col("node").alias("a"), F.col("up").alias("up_a"))
        b = points.select(F.col("node").alias("b"), F.col("up").alias("up_b"))
        edges = edges.join(a, "a").join(b, "b").where("up_a <> up_b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct()
        edges = write_shared(edges, "contracted")
    found = nodes.withColumn("root", F.col("node"))
    for points in steps:
        onward = points.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        found = found.join(onward, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_up", "root").alias("root"))
    return found
