"""Connected components of an edge table by alternating large-star and small-star steps.

All state is in tables; the driver sees only a few counts per step. The number of steps grows
with the logarithm of the longest path. It ends when each node has one edge, to a node that has none: the
smallest id that it reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over a written table. The least neighbours are written too, so that the join to them is broadcast
    where they are few, and split where one node has many edges."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        out = out.where("u != v").distinct()
    out = materialize(out, "edges")
    forget(edges, least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to one that is only led to."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("n_out"), F.lit(0).alias("n_in")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("n_out"), F.lit(1).alias("n_in")))
    node = ends.groupBy("id").agg(F.sum("n_out").alias("n_out"), F.max("n_in").alias("n_in"))
    return node.where("n_out > 1 or (n_out = 1 and n_in = 1)").isEmpty()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component): every id of an edge (u, v) with the smallest id reachable."""
    at = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    for _ in range(limit):
        if _settled(at):
            break
        at = _star(_star(at, True), False)
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
