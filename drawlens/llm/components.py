"""Connected components of a distributed edge list: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's (larger: large; other: not larger) neighbours to the least node around it.

    The least neighbour comes from a partial aggregation, so that a hub's edges are not gathered for it, and goes back to
    the edges by a join whose skewed partitions adaptive execution splits (the other side has one row a node).
    """
    out = edges.select("u", "v")
    if large:
        out = out.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        out = out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = out.join(least, "u")
    if large:
        linked = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the least node reachable.

    Loops, repeated edges and an empty list are fine; nodes without edges don't appear. Rounds go on until nothing
    changes (their number grows with the logarithm of the nodes); after `rounds` of them an error is raised.
    """
    edges = materialise(edges.where("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        if not rounds:
            raise RuntimeError("components did not settle")
        rounds -= 1
        after = materialise(star(star(edges, True), False), "edges")
        discard(edges)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
