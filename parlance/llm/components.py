"""Connected components of an edge table, by alternating large and small stars.

Edges are first contracted inside each partition by union-find, so what is
shuffled are spanning forests.  Forests of ``FEW`` edges and less are joined by
one task in the same way.  Beyond that each round hangs every node on the smallest
node next to it; rounds are written to the shared checkpoint folder and end when
nothing changes.  A node that has a third of all edges is aggregated map-side, and
adaptive execution splits its side of the join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import durable

#: Nodes that a task's union-find may have before it is sent on, and edges that one task joins (about 40 MB).
NODES, FEW = 500_000, 300_000


class Forest(dict):
    """Union-find: node -> parent, roots are the smallest nodes and have no entry."""

    def root(self, x: int) -> int:
        while (up := self.get(x)) is not None:
            if (top := self.get(up)) is not None:
                self[x] = top
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def _contract(batches):
    def edges(forest: Forest) -> pa.RecordBatch:
        nodes = list(forest)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], ["a", "b"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest) > NODES:
            yield edges(forest)
            forest = Forest()
    yield edges(forest)


def _finish(batches):
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
    roots = {x: forest.root(x) for x in list(forest)}
    nodes = [*roots, *set(roots.values())]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([roots.get(x, x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, root of each node that has an edge; edges has long columns a and b, root is the smallest node of the component."""
    small = lambda df: durable(df.where("a <> b").distinct())
    state = durable(edges.where("a <> b").mapInArrow(_contract, "a long, b long"))
    if state.limit(few + 1).count() <= few:
        return durable(state.coalesce(1).mapInArrow(_finish, "node long, root long"))
    state = small(state)
    while True:
        # large star: from each node its larger neighbours go to its smallest one
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: from each node its smaller neighbours and itself go to its smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = small(hung)
        same = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if same == state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            break
        state = after
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


