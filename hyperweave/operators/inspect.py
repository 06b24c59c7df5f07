"""Inspection: members and incidences with filters, descriptions, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperweave.functions.values import bits
from hyperweave.operators.flow import weight


def positions(inc: DataFrame) -> DataFrame:
    """Dense positions in ordered edges, -1 in set edges."""
    by = W.partitionBy("edge_id").orderBy("pos", "member_id")
    return inc.withColumn("position", F.when(F.col("kind") == "ORDERED", F.row_number().over(by) - 1).otherwise(-1).cast("long"))


def members_of(inc: DataFrame, edge: int, role: str | None = None, weights: tuple[float, float] | None = None, at: int | None = None, qualifiers: DataFrame | None = None, policy: str = "ANY", least: float = 0.5) -> DataFrame:
    """position, member, roles, weight, validity and qualifier of an edge's members; a filter loses positions.

    Policies: OBSERVED takes members without a qualifier or with an OBSERVED one, SUPPORTED those that aren't REJECTED and
    have a confidence of `least` on (1 without a qualifier), ANY all.
    """
    rows = positions(inc.where(F.col("edge_id") == edge))
    if role is not None or weights is not None or at is not None:
        rows = rows.withColumn("position", F.lit(-1).cast("long"))
    if role is not None:
        rows = rows.where(F.array_contains("roles", role))
    if weights is not None:
        rows = rows.where(weight().between(*weights))
    if at is not None:
        rows = rows.where((F.col("valid_from") <= at) & (F.col("valid_to") > at))
    if qualifiers is not None and policy != "ANY":
        q = qualifiers.select(F.col("qualifier_id").alias("qualifier"), F.col("assertion"), F.col("confidence"))
        rows = rows.join(q, "qualifier", "left")
        said, sure = F.coalesce("assertion", F.lit("OBSERVED")), F.coalesce("confidence", F.lit(1.0))
        rows = rows.where(said == "OBSERVED" if policy == "OBSERVED" else (said != "REJECTED") & (sure >= least))
    return rows.select("position", "member_id", "roles", weight().alias("weight"), "valid_from", "valid_to", "qualifier")


def incident_to(inc: DataFrame, atom: int, at: int | None = None) -> DataFrame:
    """edge, roles and position of every membership of an atom."""
    if at is not None:
        inc = inc.where((F.col("valid_from") <= at) & (F.col("valid_to") > at))
    mine = inc.where(F.col("member_id") == atom)
    # Positions need the other members of the ordered edges alone.
    ordered = inc.join(mine.where("kind = 'ORDERED'").select("edge_id"), "edge_id", "left_semi")
    placed = positions(ordered).where(F.col("member_id") == atom).select("edge_id", "roles", "position")
    return placed.union(mine.where("kind <> 'ORDERED'").select("edge_id", "roles", F.lit(-1).cast("long").alias("position")))


def describe(inc: DataFrame, atom: int, wide: DataFrame | None = None) -> DataFrame:
    """attribute and value rows of an atom: kind, cardinality, weight, degree, and its properties."""
    edge = inc.where(F.col("edge_id") == atom).agg(F.count("*").alias("cardinality"), F.coalesce(F.sum("weight_fp"), F.lit(0)).alias("w"), F.max("type").alias("type"), F.max("kind").alias("kind"))
    degree = inc.where(F.col("member_id") == atom).agg(F.count("*").alias("degree"))
    one = edge.crossJoin(degree)  # one row each
    items = {"id": F.lit(str(atom)), "type": F.col("type"), "kind": F.coalesce("kind", F.lit("NODE")), "cardinality": F.col("cardinality").cast("string"), "weight": (F.col("w") / 1e9).cast("string"), "degree": F.col("degree").cast("string")}
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), v.alias("value")) for k, v in items.items()])).alias("r")).select("r.*")
    if wide is not None:
        mine = wide.where(F.col("atom_id") == atom)
        names = [c for c in wide.columns if c not in ("atom_id", "type")]
        rows = rows.union(mine.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in names])).alias("r")).select("r.*"))
    return rows.where("value is not null")


def histogram(counts: DataFrame, column: str) -> DataFrame:
    """Numbers of rows by power of two, with the sum and the largest value of each bucket."""
    return counts.groupBy(bits(F.col(column)).alias("bucket")).agg(F.count("*").alias("rows"), F.sum(column).alias("total"), F.max(column).alias("largest"))


def cardinality_histogram(inc: DataFrame) -> DataFrame:
    return histogram(inc.groupBy("edge_id").agg(F.count("*").alias("n")), "n")


def degree_histogram(inc: DataFrame) -> DataFrame:
    return histogram(inc.groupBy("member_id").agg(F.count("*").alias("n")), "n")


def statistics(inc: DataFrame) -> DataFrame:
    """metric and value: edges, incidences, members, mean and largest cardinality and degree."""
    card = inc.groupBy("edge_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("edges"), F.sum("n").alias("incidences"), F.avg("n").alias("mean_cardinality"), F.max("n").alias("largest_cardinality"))
    deg = inc.groupBy("member_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("members"), F.avg("n").alias("mean_degree"), F.max("n").alias("largest_degree"))
    one = card.crossJoin(deg)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("r")).select("r.*")
