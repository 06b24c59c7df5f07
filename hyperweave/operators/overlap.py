"""Neighbours and overlaps: joins on members, or on pairs of members, counted per pair of edges.

Edges that share one member are as many as the squares of degrees, those that share two are few. So whatever asks for two
and more is joined on pairs of members, of which an edge has a number that doesn't depend on degrees, and what only one member
is shared by is derived from degrees or from the least ids that a member has. An edge of over SMALL members, which would have
too many pairs, is joined on its members instead. All of it is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperweave.sources.scratch import spread


#: Most members of an edge that is met through its pairs, up to 120 of them.
SMALL = 16


def _ids(inc: DataFrame, edge: str = "edge_id") -> DataFrame:
    return inc.select(F.col("edge_id").alias(edge), "member_id")


def neighbors_of_node(inc: DataFrame, node: int, threshold: int = 1) -> DataFrame:
    """Atoms that share at least `threshold` edges with the node."""
    mine = inc.where(F.col("member_id") == node).select("edge_id").distinct()
    found = _ids(inc).join(mine, "edge_id").where(F.col("member_id") != node)
    return found.groupBy(F.col("member_id").alias("neighbor")).agg(F.count("*").alias("shared")).where(F.col("shared") >= threshold)


def neighbors_of_edge(inc: DataFrame, edge: int, threshold: int = 1) -> DataFrame:
    """Edges of any type that share at least `threshold` members with the edge."""
    mine = inc.where(F.col("edge_id") == edge).select("member_id").distinct()
    found = _ids(inc).join(mine, "member_id").where(F.col("edge_id") != edge)
    return found.groupBy(F.col("edge_id").alias("neighbor")).agg(F.count("*").alias("shared")).where(F.col("shared") >= threshold)


def adjacent(inc: DataFrame, u: int, v: int, threshold: int = 1) -> DataFrame:
    """One row: whether two atoms meet in at least `threshold` edges."""
    both = inc.where(F.col("member_id").isin(u, v)).groupBy("edge_id").agg(F.countDistinct("member_id").alias("n")).where("n = 2")
    return both.agg((F.count("*") >= threshold).alias("adjacent"))


def _repeated(inc: DataFrame, weighted: bool = False) -> DataFrame:
    """left, right, overlap, and the sum of smaller weights, of the pairs of edges that share two members at least.

    Two edges that share c members share c (c - 1) / 2 pairs of members, and each member is in c - 1 of these.
    """
    by = W.partitionBy("edge_id").orderBy("member_id")
    member = F.struct("member_id", *["weight_fp"] * weighted)
    later = F.collect_list(member).over(by.rowsBetween(1, SMALL - 1))
    size = F.count("*").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = inc.select("edge_id", "member_id", *["weight_fp"] * weighted).where("edge_id is not null and member_id is not null")
    rows = spread(rows, "edge_id").select("*", later.alias("later"), (size > SMALL).alias("big"))
    two = rows.where("not big").select("edge_id", F.col("member_id").alias("a"), *[F.col("weight_fp").alias("w_a")] * weighted, F.explode("later").alias("next"))
    two = two.select("edge_id", "a", F.col("next.member_id").alias("b"), *["w_a", F.col("next.weight_fp").alias("w_b")] * weighted)
    two = spread(two, "a", "b")
    side = lambda df, name: df.select(F.col("edge_id").alias(name), *[F.col(c).alias(f"{name}_{c}" if c in ("w_a", "w_b", "weight_fp", "big") else c) for c in df.columns if c != "edge_id"])
    least = lambda w: F.coalesce(F.least(f"left_{w}", f"right_{w}"), F.lit(0))
    both = side(two, "left").join(side(two, "right"), ["a", "b"]).where(F.col("left") < F.col("right"))
    counted = both.groupBy("left", "right").agg(F.count("*").alias("n"), *[F.sum(least("w_a") + least("w_b")).alias("weight_fp")] * weighted)
    overlap = F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long")
    small = counted.select("left", "right", overlap.alias("overlap"), *["weight_fp"] * weighted)
    if weighted:
        small = small.withColumn("weight_fp", F.expr("weight_fp div (overlap - 1)"))
    plain = rows.drop("later")
    far = side(plain.where("big"), "left").drop("left_big").join(side(plain, "right"), "member_id").where("left <> right and (left < right or not right_big)")
    far = far.groupBy(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).agg(F.count("*").alias("overlap"), *[F.sum(least("weight_fp")).alias("weight_fp")] * weighted)
    return small.union(far.where("overlap > 1"))


def overlap_join(inc: DataFrame, threshold: int = 1, prefix: bool = False) -> DataFrame:
    """Pairs of edges, the smaller id left, that share at least `threshold` members (a threshold under 1 is 1).

    prefix changes nothing any more: from a threshold of two on members are met in pairs, so that hubs cost no more than others.
    """
    if threshold > 1:
        return _repeated(inc).where(F.col("overlap") >= threshold)
    left, right = (_ids(inc, side) for side in ("left", "right"))
    return left.join(right, "member_id").where("left < right").groupBy("left", "right").agg(F.count("*").alias("overlap"))


def overlap_histogram(inc: DataFrame) -> DataFrame:
    """How many pairs of edges share each number of members, from 1.

    Pairs of memberships of one member are known from degrees; those that pairs with more in common don't explain share one.
    """
    more = overlap_join(inc, 2).groupBy("overlap").agg(F.count("*").alias("pairs"))
    explained = F.array(F.struct("overlap", "pairs"), F.struct(F.lit(1).cast("long").alias("overlap"), (-F.col("overlap") * F.col("pairs")).alias("pairs")))
    d = inc.where("edge_id is not null and member_id is not null").groupBy("member_id").agg(F.count("*").alias("d"))
    met = d.agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).alias("pairs")).select(F.lit(1).cast("long").alias("overlap"), "pairs")
    every = more.select(F.explode(explained).alias("r")).select("r.overlap", "r.pairs").union(met)
    return every.groupBy("overlap").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def weighted_overlap(inc: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Pairs of edges with the sum over shared members of the smaller weight, in billionths."""
    enough = lambda c: F.col(c) > threshold * 1e9
    repeated = _repeated(inc, weighted=True)
    # Edges that share one member share enough only if its weight is enough in both.
    rows = inc.where(enough("weight_fp") | F.col("weight_fp").isNull())
    left, right = (rows.select(F.col("edge_id").alias(side), "member_id", F.col("weight_fp").alias(f"w_{side}")) for side in ("left", "right"))
    met = left.join(right, "member_id").where("left < right").select("left", "right", F.least("w_left", "w_right").alias("weight_fp")).where(enough("weight_fp"))
    both = met.withColumn("whole", F.lit(None).cast("long")).union(repeated.select("left", "right", F.lit(None).cast("long"), "weight_fp"))
    sums = both.groupBy("left", "right").agg(F.coalesce(F.max("whole"), F.max("weight_fp")).alias("weight_fp"))
    return sums.where(enough("weight_fp"))


def overlap_top(inc: DataFrame, k: int) -> DataFrame:
    """For each edge its k partners of largest overlap, equal ones by id.

    A partner that shares one member only is among the k least edges of this member, as all before it would come first.
    """
    pairs = overlap_join(inc, 2)
    both = pairs.select(F.explode(F.array(F.struct(F.col("left").alias("edge_id"), F.col("right").alias("partner"), "overlap"), F.struct(F.col("right").alias("edge_id"), F.col("left").alias("partner"), "overlap"))).alias("r")).select("r.*")
    rows = _ids(inc).where("edge_id is not null and member_id is not null")
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("member_id").orderBy("edge_id"))).where(F.col("n") <= k + 1)
    first = first.groupBy("member_id").agg(F.sort_array(F.collect_list("edge_id")).alias("first"))
    near = rows.join(first, "member_id").select("edge_id", F.explode(F.slice(F.filter("first", lambda e: e != F.col("edge_id")), 1, k)).alias("partner"), F.lit(1).cast("long").alias("overlap"))
    both = both.union(near).repartition("edge_id").groupBy("edge_id", "partner").agg(F.max("overlap").alias("overlap"))
    by = W.partitionBy("edge_id").orderBy(F.desc("overlap"), "partner")
    return both.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
