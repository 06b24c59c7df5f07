"""Materialised views, from a snapshot and step by step from changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweave.operators.overlap import overlap_top

MOST_BUCKET, MOST_K = 366 * 86_400_000, 1000


def degree(changes: DataFrame) -> DataFrame:
    """Atoms with their degree, from changes (edge_id, member_id, delta); those at 0 are absent."""
    return changes.groupBy("member_id").agg(F.sum("delta").alias("degree")).where("degree > 0")


def cardinality(changes: DataFrame) -> DataFrame:
    return changes.groupBy("edge_id").agg(F.sum("delta").alias("cardinality")).where("cardinality > 0")


def activity(changes: DataFrame, bucket: int = 60_000) -> DataFrame:
    """Memberships added and removed by tumbling time bucket, from changes (at, delta); empty buckets are absent."""
    if not 0 < bucket <= MOST_BUCKET:
        raise ValueError("a bucket has from 1 ms to 366 days")
    start = (F.floor(F.col("at") / bucket) * bucket).cast("long")
    sums = changes.groupBy(start.alias("bucket")).agg(F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)).alias("added"), F.sum(F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0)).alias("removed"))
    return sums.where("added > 0 or removed > 0")


def overlaps(inc: DataFrame, k: int) -> DataFrame:
    """For each edge the array of its k partners of largest overlap."""
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k is from 1 to {MOST_K}")
    top = overlap_top(inc, k)
    return top.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("place", "partner", "overlap"))).alias("ranked"))


def refreshed(view: DataFrame, delta: DataFrame, key: str, value: str) -> DataFrame:
    """A count view after more changes: both are summed, rows at 0 go."""
    return view.select(key, value).union(delta.select(key, value)).groupBy(key).agg(F.sum(value).alias(value)).where(F.col(value) != 0)


def affected(inc: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges whose overlap rows can have changed: those changed, and those that share a changed member."""
    touched = changes.select("member_id").distinct()
    return changes.select("edge_id").union(inc.join(touched, "member_id", "left_semi").select("edge_id")).distinct()


def staleness(commits: DataFrame, last: int) -> DataFrame:
    """Commits since the generation that a view was refreshed at."""
    return commits.where(F.col("gen") > last).agg(F.count("*").alias("behind"))
