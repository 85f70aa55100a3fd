"""Distributed connected components by alternating large and small stars.

Each star step is one map-side combined minimum per node and one join of the edges with those
minima, so a node with a third of all edges is a skewed join, which adaptive execution splits,
and never a group in one task. Edges are made once; rounds are cut by reliable checkpoints, and their
number grows with the logarithm of the longest path. Only whether stars are left reaches the driver in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.session import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Self-links, repeated edges and edges with a null end are allowed; null ends are ignored. A node
    with self-links only forms its own component. No edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    # they may be costly to make, and are read twice
    pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = pairs.where("a = b").select(F.col("a").alias("node"))
    stars = pairs.where("a <> b")
    while True:
        # cut in between, else what reads the large stars twice makes them twice
        stars = durable(_small(durable(_large(stars))))
        if _settled(stars):
            break
    member = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = member.union(roots)
    alone = nodes.join(found.select("node").distinct(), "node", "left_anti")
    return found.union(alone.select("node", F.col("node").alias("component")))


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours; edges may repeat."""
    up = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    lowest = _both(edges, ("a", "b"), ("b", "a")).groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return up.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(down: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours ``b`` to the smallest of them."""
    lowest = down.groupBy("a").agg(F.min("b").alias("m"))
    return _both(down.join(lowest, "a"), ("b", "m"), ("a", "m")).where("a <> b").distinct()


def _both(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(a, b): several pairs of columns of each row, in one pass."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])))


def _settled(stars: DataFrame) -> bool:
    """Whether every node with an edge to a smaller one has just that, and no larger neighbours: stars, each around its smallest node."""
    up = F.struct(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger"))
    down = F.struct(F.col("b").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger"))
    ends = stars.select(F.inline(F.array(up, down))).groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return ends.where("smaller > 1 or smaller = 1 and larger = 1").isEmpty()
