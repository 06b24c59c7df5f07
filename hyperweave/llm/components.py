"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweave.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connects each vertex's larger (or smaller) neighbours to its smallest one; sums by key combine before the shuffle."""
    if large:
        seen = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # A written table, so that the join may split a hub's rows among tasks, which it can't where one side is still to be summed.
    least = written(least, "least")
    joined = seen.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either a centre or hangs on one centre: (child, centre) rows of disjoint stars."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("leads")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("leads")))).alias("e")).select("e.*")
    each = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("leads").alias("leads"))
    return each.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("leads") > 0))).isEmpty()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); component is the smallest node reachable.

    Nodes without edges don't appear. Loops and repeated edges don't matter. Each round ends in a written table.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v")
    for _ in range(rounds):
        edges = written(_star(_star(edges, True), False), "stars")
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
