"""Connected components over an edge table, by alternating stars.

Edges are first thinned to a spanning forest inside each partition (union-find over one
partition's rows), then large-star and small-star rounds run on min-aggregates and joins until
the edge set is stable. No vertex's neighbourhood is ever gathered in one place: a hub is a
skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _forest(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = list(parent)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of u, and u itself, are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links between longs -> (node, root): the least node reachable, for each linked node.

    Self links and repeated links change nothing; an empty table gives an empty table. Nodes
    without links don't appear. Raises if `rounds` rounds don't settle the edge set.
    """
    now = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = cut(now.mapInArrow(_forest, "u long, v long"))
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        now = cut(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
