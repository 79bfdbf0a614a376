"""Distributed connected components (union-find) over an edge table.

First every task contracts the edges that it holds with a union-find of bounded
size, which turns any group into stars and leaves a hub with few edges; then
rounds of large-star and small-star run until nothing moves.  A hub's edges are
never gathered: the least neighbour comes from a partial aggregation, and the
join that follows is one that adaptive execution splits when skewed.  Each round
is written to the shared folder, so a lost executor costs at most a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, settled


class UnionFind:
    """Over any integers; roots are the least members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root and p != x:
            parent[x] = root
            x = p
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if a < b:
                a, b = b, a
            self.parent[a] = b


def contract(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Edges (a, b) to stars with the same components within each task; at most ``most`` nodes in memory."""

    def stars(uf: UnionFind):
        if uf.parent:
            nodes = list(uf.parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([uf.find(x) for x in nodes], pa.int64())], names=["a", "b"])

    def run(batches):
        claim("components")
        uf = UnionFind()
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            for x, y in pairs.tolist():
                uf.union(x, y)
            if len(uf.parent) > most:
                yield from stars(uf)
                uf = UnionFind()
        yield from stars(uf)

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge that isn't a loop; component is the least node reachable.

    Null ends are ignored; loops and repeated edges change nothing; no edges give no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = settled(contract(e).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hop = large.join(least, "a")
        small = hop.select("a", F.col("m").alias("b")).unionByName(hop.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        e = settled(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
