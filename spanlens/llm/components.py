"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.storage import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u long, v long)`` edges to ``(node long, component long)``.

    ``component`` is the smallest node reachable.  Nodes without an edge to
    another node are absent; null ends, loops and repeated edges are ignored.

    Alternating large-star and small-star rounds: every round links each node
    to the smallest of its neighbours, so the number of rounds grows with the
    logarithm of the longest path.  Each round is an aggregate with map-side
    combine and one equi-join that adaptive execution can split on a hot node;
    no neighbour list is ever gathered.  Only two sums reach the driver.
    """
    now = materialize(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or tuple(seen) == before:
            break
        before = tuple(seen)
        large = _star(now, large=True)
        after = materialize(_star(large, large=False), "edges")
        release(now)
        now = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges ``u > v`` to the edges of one star round, again ``u > v``."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        # every larger neighbour of u moves to the least of u and its neighbours
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("n"))
        least = least.select("c", F.least("c", "n").alias("m"))
        moved = edges.join(least, edges.v == least.c).select("u", F.col("m").alias("v"))
        return moved.where("u <> v").distinct()
    # u and its smaller neighbours move to the least of them
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    moved = edges.join(least, edges.u == least.c).select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select(F.col("c").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(kept).where("u <> v").distinct()
