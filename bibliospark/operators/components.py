"""Connected components of a graph of any shape, in a logarithmic number of rounds.

Alternating large-star and small-star steps (Kiveris, Lattanzi, Mirrokni,
Rastogi and Vassilvitskii, "Connected components in MapReduce and beyond",
2014) turn every component into a star around its smallest node. Each step is
a minimum per node, combined before the shuffle, and a join, so a node with
very many neighbours is no task of its own. Before the first round, some
edges at a time are replaced by stars that join the same nodes, which settles
a small graph at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.sources.durable import keep


#: Nodes that a task holds while it thins edges.
THINNED_NODES = 200_000


class Forest:
    """Disjoint sets over values that are numbered as they come."""

    def __init__(self) -> None:
        self.number: dict[int, int] = {}
        self.parent: list[int] = []

    def find(self, value: int) -> int:
        at = self.number.setdefault(value, len(self.parent))
        if at == len(self.parent):
            self.parent.append(at)
        parent = self.parent
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    def join(self, a: int, b: int) -> bool:
        """Join two sets; false if they were one."""
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of some edges at a time: every node with the smallest that these edges reach."""

    def stars(forest: Forest) -> pa.RecordBatch:
        nodes = np.array(list(forest.number), dtype=np.int64)
        roots = np.array([forest.find(n) for n in forest.number], dtype=np.int64)
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, nodes)
        low = least[roots] if len(nodes) else nodes
        apart = nodes != low
        return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(low[apart])], ["a", "b"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        if len(forest.number) > THINNED_NODES:
            yield stars(forest)
            forest = Forest()
    yield stars(forest)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is a centre or has one edge, up to a centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node near it."""
    both = _mirrored(edges)
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours to the smallest of them; edges run from ``a`` down to ``b``."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(lowest, "a").where(F.col("b") > F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node that has an edge; the smallest node names its component.

    Nodes are longs. Repeated edges, edges both ways and self-loops are
    allowed; an edge with a null is none. A node with only a self-loop comes
    out alone. No edges give no rows.
    """
    pairs = edges.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b"))
    pairs = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = pairs.where(F.col("a") == F.col("b")).select("a").distinct()
    # small partitions are put together first, so that few edges are thinned as one
    apart = pairs.where(F.col("a") != F.col("b")).hint("rebalance")
    current = keep(apart.mapInArrow(_thin, "a long, b long"), "edges")
    while not _are_stars(current):
        current = keep(_small_star(_large_star(current)), "stars")
    roots = current.select(F.col("b").alias("a")).distinct()
    alone = roots.unionByName(loops.join(current.select("a"), "a", "left_anti")).distinct()
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(alone.select(F.col("a").alias("node"), F.col("a").alias("component")))
