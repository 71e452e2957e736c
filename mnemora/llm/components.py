"""Connected components by alternating large-star and small-star steps.

Each step is a shuffle of the edges; nothing is gathered on the driver but one number per round. Before
the first round every task turns its share of the edges, SHARE at most on average, into stars over the
nodes that they connect: a dense group's many edges become at most one per node and task, and no
connection is lost. Every round writes its edges to the shared folder, which ends their lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


SHARE = 500_000


class Forest:
    """Sets of numbers that edges have joined so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def joined(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """The edges (a, b) that join two sets: a spanning forest of all that were given."""
        left, right = [], []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                left.append(x)
                right.append(y)
        return left, right


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as edges (node, smallest node that these edges connect it with)."""
    forest = Forest()
    for batch in batches:
        forest.joined(*(batch.column(i).to_numpy() for i in (0, 1)))
    nodes = [x for x, up in forest.parent.items() if up != x]
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.root(x) for x in part], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b); no edges give no rows. Rounds go on
    until one changes nothing, some log of the longest path many."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = written(e, spark, "edges")
    e = written(e.repartition(1 + e.count() // SHARE).mapInArrow(stars, "a long, b long"), spark, "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.*")
            .where("a <> b")
            .distinct()
        )
        e = written(small, spark, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")).first()
        if now == before:
            break
        before = now
    star = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
