"""Null models: random swaps that keep every member's degree and every edge's size."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperweave.sources.scratch import written


class Sample(NamedTuple):
    """The incidences after the swaps, and how many attempts took place and how many were rejected."""

    rows: DataFrame
    accepted: int
    rejected: int


def swap_members(inc: DataFrame, swaps: int, seed: int = 1) -> Sample:
    """The incidences of set edges after `swaps` attempts to let two memberships of two edges exchange their members.

    An attempt is rejected if both have the same member, or either edge has the other's member already; roles, weights and
    periods stay with the place. Attempts are made in rounds: edges are paired at random and each pair draws a membership of
    either, so no two attempts of a round touch one edge and all of them can be decided at once. The last round makes as many
    as are left. Every round ends in a written table of ids, so plans stay as long as one round's. Random numbers are hashes of
    ids, the round and the seed, so a seed gives the same sample again. With under two edges all attempts are rejected.
    """
    rows = inc.where("kind = 'SET'")
    # `slot` names a membership by the member that it began with.
    now = written(rows.select("edge_id", F.col("member_id").alias("slot"), "member_id"), "slots")
    left, accepted, turn = swaps, 0, 0
    edges = now.select("edge_id").distinct().count()
    while left > 0 and edges > 1:
        key = F.xxhash64(F.lit(seed), F.lit(turn), "edge_id", "slot")
        drawn = now.groupBy("edge_id").agg(F.min_by(F.struct("slot", "member_id"), key).alias("at"))
        # As many blocks as half the edges; the first two of a block by hash are a pair.
        order = F.xxhash64(F.lit(seed + 1), F.lit(turn), "edge_id")
        ranked = drawn.withColumn("order", order).withColumn("block", F.pmod(F.xxhash64("order"), F.lit(max(1, edges // 2))))
        ranked = ranked.withColumn("place", F.row_number().over(W.partitionBy("block").orderBy("order", "edge_id"))).where("place <= 2")
        sides = F.struct("edge_id", "at.slot", "at.member_id")
        pairs = ranked.groupBy("block").agg(F.max(F.when(F.col("place") == 1, sides)).alias("a"), F.max(F.when(F.col("place") == 2, sides)).alias("b")).where("b is not null")
        pairs = written(pairs.orderBy("block").limit(left) if left < edges // 2 else pairs, "pairs")
        tried = pairs.count()
        held = now.select("edge_id", "member_id")
        there = lambda e, m: (held["edge_id"] == F.col(e)) & (held["member_id"] == F.col(m))
        fine = pairs.where("a.member_id != b.member_id").join(held, there("a.edge_id", "b.member_id"), "left_anti").join(held, there("b.edge_id", "a.member_id"), "left_anti")
        move = lambda x, y: F.struct(F.col(f"{x}.edge_id").alias("edge_id"), F.col(f"{x}.slot").alias("slot"), F.col(f"{y}.member_id").alias("new"))
        moves = written(fine.select(F.explode(F.array(move("a", "b"), move("b", "a"))).alias("m")).select("m.*"), "moves")
        accepted += moves.count() // 2
        now = written(now.join(moves, ["edge_id", "slot"], "left").select("edge_id", "slot", F.coalesce("new", "member_id").alias("member_id")), "slots")
        left, turn = left - tried, turn + 1
    moved = now.where("slot != member_id").select("edge_id", F.col("slot").alias("member_id"), F.col("member_id").alias("new"))
    out = rows.join(moved, ["edge_id", "member_id"], "left").withColumn("member_id", F.coalesce("new", "member_id")).select(*inc.columns)
    return Sample(out, accepted, swaps - accepted)
