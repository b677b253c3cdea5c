"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's larger (or its other) neighbours to the smallest node around it.

    The smallest neighbour comes from an aggregation combined on the map side, and joins back on the
    node, so that a node with many links is split like any skewed join.
    """
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the smallest node it can reach.

    Loops, repeated edges and both directions are fine; rows with a null end are ignored; no edges give
    no rows. Each round is cut off by a checkpoint; the rounds grow as the logarithm of the longest path.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(edges)
    state = None
    for _ in range(max_rounds):
        new = _star(edges, large=True).where("u <> v").distinct()
        new = checkpointed(_star(new, large=False).where("u <> v").distinct())
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        edges = new
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
