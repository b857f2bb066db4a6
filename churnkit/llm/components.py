"""Connected components of an edge table, without collecting links or labels.

Rounds of large-star and small-star joins over a checkpointed edge table; before
each round every partition replaces its own edges by a spanning forest of
stars, so that long chains shrink fast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnkit.session import reliable


class Forest:
    """Union-find over arbitrary integer ids; the root is the smallest id of a tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def _stars(batches):
    """Edges of one partition as (node, smallest node of its tree); flushed when the forest grows large."""
    forest = Forest()

    def flush():
        nodes = [x for x in forest.parent if forest.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()),
                                           pa.array([forest.find(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.union(a, b)
        if len(forest.parent) > 1_000_000:
            yield flush()
            forest = Forest()
    yield flush()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    joined = down.join(low, down.a == low.u)
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``edges`` has long columns a and b.  Links with a null end and links of a
    node with itself are ignored; repeated and reversed links count once.
    """
    edges = edges.where("a <> b").select("a", "b")
    before = None
    while True:
        edges = reliable(_small_star(_large_star(edges.mapInArrow(_stars, "a bigint, b bigint"))))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = now
