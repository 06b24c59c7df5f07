"""Evidence behind memberships, states of atoms, and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace(assertions: DataFrame, evidence: DataFrame, start: int, depth: int = 8) -> DataFrame:
    """step (array that sorts depth-first), id, kind and whether the id was met before on the walk.

    assertions: (id, evidence array<long>); evidence: (id, source long). The walk goes from an assertion to its evidence, from
    evidence to the assertion that is its source. An id met a second time anywhere ends its branch as `cycle`.
    """
    links = assertions.select("id", F.posexplode("evidence").alias("n", "to"), F.lit("evidence").alias("kind")).union(evidence.where("source is not null").select("id", F.lit(0).alias("n"), F.col("source").alias("to"), F.lit("source").alias("kind")))
    level = assertions.sparkSession.range(1).select(F.array(F.lit(0)).alias("step"), F.lit(start).cast("long").alias("id"), F.lit("assertion").alias("kind"), F.array(F.lit(start).cast("long")).alias("path"))
    out = level
    for _ in range(depth - 1):
        going = level.where(F.size("path") == F.size(F.array_distinct("path")))
        level = going.join(links.withColumnRenamed("kind", "next"), "id").select(F.concat("step", F.array("n")).alias("step"), F.col("to").alias("id"), F.col("next").alias("kind"), F.concat("path", F.array("to")).alias("path"))
        out = out.union(level)
    first = out.groupBy("id").agg(F.min("step").alias("first"))
    # What hangs below a repeated id isn't walked again.
    above = out.select("step", F.posexplode("path").alias("i", "at")).where(F.col("i") < F.size("step") - 1)
    again = above.join(first.withColumnRenamed("id", "at"), "at").where(F.slice("step", 1, F.col("i") + 1) != F.col("first")).select("step").distinct()
    walked = out.join(again, "step", "left_anti")
    return walked.join(first, "id").select("step", "id", F.when(F.col("step") == F.col("first"), F.col("kind")).otherwise("cycle").alias("kind"))


def with_evidence(inc: DataFrame, edge: int, member: int, qualifier: int) -> DataFrame:
    """The incidences with a membership's qualifier set."""
    hit = (F.col("edge_id") == edge) & (F.col("member_id") == member)
    return inc.withColumn("qualifier", F.when(hit, F.lit(qualifier).cast("long")).otherwise(F.col("qualifier")))


def state_at(states: DataFrame, at: int | None = None) -> DataFrame:
    """The binding of each atom in states (atom_id, schema, value, valid_from, valid_to, version): the latest, if it holds at the time."""
    latest = states.groupBy("atom_id").agg(F.max_by(F.struct("schema", "value", "valid_from", "valid_to", "version"), "version").alias("s")).select("atom_id", "s.*")
    return latest if at is None else latest.where((F.col("valid_from") <= at) & (F.col("valid_to") > at))


def signals_for(inc: DataFrame, signals: DataFrame, edges: list[int], begin: int, end: int) -> DataFrame:
    """Signals (signal_id, atom_id, begin, end) that overlap a window, of members of the edges that are valid within it."""
    atoms = inc.where(F.col("edge_id").isin(*edges) & (F.col("valid_from") < end) & (F.col("valid_to") > begin)).select(F.col("member_id").alias("atom_id")).distinct()
    return signals.join(atoms, "atom_id", "left_semi").where((F.col("begin") < end) & (F.col("end") > begin))
