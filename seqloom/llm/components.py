"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.sources import discard, stage

#: So many edges fit in one task, whose union-find then ends the rounds.
FEW = 200_000


class Forest:
    """Union-find over the nodes of a task."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def joins(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contracted(edges: DataFrame, most: int | None = FEW) -> DataFrame:
    """The edges of each task as edges from its nodes to the least node that they reach there; a task starts anew after `most` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kind = Forest(), None

        def stars() -> pa.RecordBatch:
            nodes = list(forest.up)
            return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([forest.root(n) for n in nodes], kind)], ["a", "b"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.joins(a, b)
            if most and len(forest.up) > most:
                yield stars()
                forest = Forest()
        if forest.up:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One round: neighbours of each node (all, or those not above it) point to the least of them and the node."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """edges: a, b (comparable, not null). Returns node, root: the least node that it reaches; nodes without an edge are absent.

    Tasks contract their own edges first. As long as more than `few` edges are left, rounds of large and small stars follow, each
    written to the shared folder; they keep at most one edge for each edge they had and end when no edge changes. A few edges
    are ended by one task.
    """
    now, mark = stage(_contracted(edges.filter("a <> b").select("a", "b"))), None
    while True:
        rows, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if rows <= few:
            last = stage(_contracted(now.coalesce(1), None))
            break
        if (rows, total) == mark:
            last = now
            break
        mark, last = (rows, total), now
        now = stage(_contracted(_star(_star(now, True), False)))
        discard(last)
    return last.select(F.col("a").alias("node"), F.col("b").alias("root")).union(last.select(F.col("b"), F.col("b")).distinct())
