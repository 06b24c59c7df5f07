"""Nested edges and subsets: expansion, closure, and neighbourhood graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperweave.sources.scratch import written


def expand(inc: DataFrame, edge: int, depth: int = 4, budget: int | None = None, edges: DataFrame | None = None) -> DataFrame:
    """path, atom, status and place of a depth-first walk through members and members of members.

    A path goes from the root to the atom itself. EMIT is a member that is no edge. An edge among members is entered, without
    a row of its own, unless it is on its own path already, CYCLE, or `depth` edges have been entered before it, DEPTH_LIMIT.
    Entering an edge, the root too, costs a step, as every row does; with a budget of steps the first that can't be paid for
    has the status BUDGET_EXHAUSTED and ends the walk. `place` orders rows as the walk meets them: members by position, then
    id. edges (edge_id) names edges without members, too; else those with members are known. A node as the root is an error.
    """
    if not 1 <= depth <= 64:
        raise ValueError("depth is from 1 to 64")
    heads = (inc if edges is None else edges).select("edge_id").distinct()
    if heads.where(F.col("edge_id") == edge).limit(1).count() == 0:
        raise ValueError(f"{edge} is not an edge")
    links = inc.select("edge_id", F.col("member_id").alias("member"), F.struct("pos", "member_id").alias("by"))
    nested = heads.select(F.col("edge_id").alias("member"), F.lit(True).alias("nested"))
    root = F.lit(edge).cast("long")
    level = inc.sparkSession.range(1).select(F.array(root).alias("path"), root.alias("atom"), F.array().cast("array<struct<pos:bigint,member_id:bigint>>").alias("place"), F.lit(False).alias("cycle"))
    steps = []
    for d in range(depth + 1):
        status = F.when(F.col("cycle"), "CYCLE").when(F.lit(d == depth), "DEPTH_LIMIT")
        steps.append(level.select("path", "atom", status.alias("status"), "place"))
        if d == depth:
            break
        inner = level.where("not cycle").select("path", F.col("atom").alias("edge_id"), "place").join(links, "edge_id").join(nested, "member", "left")
        below = written(inner.select(F.concat("path", F.array("member")).alias("path"), F.col("member").alias("atom"), F.concat("place", F.array("by")).alias("place"), F.array_contains("path", F.col("member")).alias("cycle"), F.coalesce("nested", F.lit(False)).alias("nested")), "level")
        steps.append(below.where("not nested").select("path", "atom", F.lit("EMIT").alias("status"), "place"))
        level = below.where("nested").select("path", "atom", "place", "cycle")
    walk = reduce(DataFrame.union, steps)
    if budget is not None:
        # The walk is as short as the budget, so one sorted take and the place of its last row do.
        first = walk.orderBy("place").limit(budget + 1).select("*", F.row_number().over(W.orderBy("place")).alias("n"))
        walk = first.withColumn("status", F.when(F.col("n") > budget, "BUDGET_EXHAUSTED").otherwise(F.col("status"))).drop("n")
    return walk.where("status is not null")


def closure(inc: DataFrame, edge: int, dim: int, limit: int | None = None) -> DataFrame:
    """All subsets of an edge's members of 1 to dim + 1 members, as arrays in membership order, with their size.

    Subsets grow by a later member at a time, so each comes once. `limit` takes the first by size, then order. The members of
    the one edge, of which there are at most as many as subsets, go to all tasks, and the subsets are dealt out.
    """
    base = inc.where(F.col("edge_id") == edge).select(F.struct("pos", "member_id").alias("by"))
    subsets = base.select(F.array("by").alias("places"))
    out = subsets
    for _ in range(dim):
        subsets = subsets.repartition("places").join(F.broadcast(base), F.element_at("places", -1) < F.col("by")).select(F.concat("places", F.array("by")).alias("places"))
        out = out.union(subsets)
    rows = out.select(F.size("places").cast("long").alias("size"), F.col("places.member_id").alias("members"), "places")
    if limit is not None:
        rows = rows.orderBy("size", "places").limit(limit)
    return rows.select("size", "members")


def neighborhood(inc: DataFrame, seeds: list[int], hops: int = 1, most: int = 1000) -> DataFrame:
    """Incidences within `hops` steps of the seeds, with the step; a hop keeps the `most` smallest new atoms."""
    spark = inc.sparkSession
    reached = spark.range(1).select(F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("atom"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        at = reached.select("atom")
        touched = inc.join(at.withColumnRenamed("atom", "member_id"), "member_id", "left_semi").select("edge_id").union(inc.join(at.withColumnRenamed("atom", "edge_id"), "edge_id", "left_semi").select("edge_id")).distinct()
        atoms = inc.join(touched, "edge_id", "left_semi").select(F.explode(F.array("edge_id", "member_id")).alias("atom")).distinct()
        fresh = atoms.join(at, "atom", "left_anti").orderBy("atom").limit(most)
        reached = reached.union(fresh.withColumn("hop", F.lit(hop)))
    ids = reached.select("atom", "hop")
    a = ids.select(F.col("atom").alias("edge_id"), F.col("hop").alias("edge_hop"))
    b = ids.select(F.col("atom").alias("member_id"), F.col("hop").alias("member_hop"))
    return inc.join(a, "edge_id").join(b, "member_id").select("edge_id", "member_id", F.greatest("edge_hop", "member_hop").alias("hop"))
