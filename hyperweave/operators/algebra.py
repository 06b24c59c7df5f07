"""Set algebra on the members of two edges, and scans by what edges contain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(inc: DataFrame, edge: int) -> DataFrame:
    """Distinct members of an edge."""
    return inc.where(F.col("edge_id") == edge).select("member_id").distinct()


def intersect(inc: DataFrame, a: int, b: int) -> DataFrame:
    return members(inc, a).intersect(members(inc, b))


def union(inc: DataFrame, a: int, b: int) -> DataFrame:
    return inc.where(F.col("edge_id").isin(a, b)).select("member_id").distinct()


def difference(inc: DataFrame, a: int, b: int) -> DataFrame:
    return members(inc, a).exceptAll(members(inc, b))


def counts(inc: DataFrame, a: int, b: int) -> DataFrame:
    """One row: sizes of both edges (n_a, n_b) and of their overlap, in one pass over the rows of the two edges."""
    sides = inc.where(F.col("edge_id").isin(a, b)).groupBy("member_id").agg(F.max((F.col("edge_id") == a).cast("long")).alias("a"), F.max((F.col("edge_id") == b).cast("long")).alias("b"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sides.agg(total(F.col("a")).alias("n_a"), total(F.col("b")).alias("n_b"), total(F.col("a") * F.col("b")).alias("overlap"))


def measures(inc: DataFrame, a: int, b: int) -> DataFrame:
    """subset, equal, jaccard (1 for two empty edges), containment (0 if one is empty) and overlap."""
    n_a, n_b, both = F.col("n_a"), F.col("n_b"), F.col("overlap")
    least = F.least(n_a, n_b)
    either = n_a + n_b - both
    return counts(inc, a, b).select(
        (both == n_a).alias("subset"),
        ((both == n_a) & (both == n_b)).alias("equal"),
        F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1))).alias("jaccard"),
        F.when(least == 0, 0.0).otherwise(both / F.greatest(least, F.lit(1))).alias("containment"),
        both.alias("overlap"),
    )


def combined(inc: DataFrame, a: int, b: int, how: str, into: int) -> DataFrame:
    """The incidences of a new SET edge from two; where both have a member the left edge's row stays."""
    both = inc.where(F.col("edge_id").isin(a, b))
    if both.where("kind <> 'SET'").limit(1).count():
        raise ValueError("only SET edges can be combined into a new edge")
    sides = F.struct((F.col("edge_id") != a).alias("right"), *[F.col(c) for c in inc.columns])
    rows = both.groupBy("member_id").agg(F.min_by(sides, F.col("edge_id") != a).alias("row"), F.max((F.col("edge_id") == a).cast("int")).alias("a"), F.max((F.col("edge_id") == b).cast("int")).alias("b"))
    keep = {"union": F.lit(True), "intersect": (F.col("a") == 1) & (F.col("b") == 1), "difference": (F.col("a") == 1) & (F.col("b") == 0)}[how]
    return rows.where(keep).select("row.*").drop("right").withColumn("edge_id", F.lit(into).cast("long")).withColumn("type", F.lit(inc.where(F.col("edge_id") == a).first()["type"]))


def containing(inc: DataFrame, wanted: list[int | tuple[int, list[str]]]) -> DataFrame:
    """Edges that contain all given members, each optionally with all of some roles.

    One scan of the wanted rows and one count per edge; a member asked for twice must fit both times.
    """
    legs = [(w, []) if isinstance(w, int) else w for w in wanted]
    if not legs:
        return inc.select("edge_id").distinct()
    hits = []
    for member, roles in legs:
        hit = F.col("member_id") == member
        for role in roles:
            hit &= F.array_contains("roles", role)
        hits.append(F.max(hit.cast("int")))
    rows = inc.where(F.col("member_id").isin(*sorted({m for m, _ in legs})))
    return rows.groupBy("edge_id").agg(F.array_min(F.array(*hits)).alias("all")).where("all = 1").select("edge_id")
