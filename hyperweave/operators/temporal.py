"""Time: snapshots of a change log, differences, three-way merges, history.

A log row is a full incidence row with gen (a whole number that grows by commit), branch and op (PUT or REMOVE); a later row
of the same edge and member replaces an earlier one. Everything here is aggregation by (edge, member), so it shuffles once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperweave.sources.scratch import spread

KEY = ["edge_id", "member_id"]
PAYLOAD = ["type", "kind", "pos", "roles", "weight_fp", "valid_from", "valid_to", "qualifier"]


def visible(log: DataFrame, lineage: list[tuple[str, int]]) -> DataFrame:
    """Log rows of a branch: its own, and those of each ancestor up to the generation it was forked from."""
    keep = F.lit(False)
    for branch, last in lineage:
        keep = keep | ((F.col("branch") == branch) & (F.col("gen") <= last))
    return log.where(keep)


def snapshot(log: DataFrame, gen: int, lineage: list[tuple[str, int]] | None = None) -> DataFrame:
    """The incidences as of a generation: the latest row of each edge and member, unless it removes."""
    rows = visible(log, lineage) if lineage else log
    latest = rows.where(F.col("gen") <= gen).groupBy(*KEY).agg(F.max_by(F.struct("op", *PAYLOAD), "gen").alias("row"))
    return latest.where("row.op = 'PUT'").select(*KEY, *[F.col(f"row.{c}").alias(c) for c in PAYLOAD])


def generation_at(commits: DataFrame, millis: int) -> int | None:
    """The newest generation committed at a time or before."""
    return commits.where(F.col("at") <= millis).agg(F.max("gen")).first()[0]


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """edge, member and change between two snapshots: ADDED, REMOVED or UPDATED memberships, and CREATED or DELETED edges."""
    left = a.select(*KEY, F.struct(*PAYLOAD).alias("old"))
    right = b.select(*KEY, F.struct(*PAYLOAD).alias("new"))
    return _differences(left.join(right, KEY, "full_outer"))


def diff_between(log: DataFrame, a: int, b: int, lineage: list[tuple[str, int]] | None = None) -> DataFrame:
    """`diff` of two generations of one log, which is read and shuffled once for both."""
    rows = (visible(log, lineage) if lineage else log).where(F.col("gen") <= max(a, b))
    at = lambda g: F.max_by(F.struct("op", *PAYLOAD), F.when(F.col("gen") <= g, F.col("gen")))
    both = rows.groupBy(*KEY).agg(at(a).alias("old"), at(b).alias("new"))
    there = lambda c: F.when(F.col(f"{c}.op") == "PUT", F.struct(*[F.col(f"{c}.{x}").alias(x) for x in PAYLOAD])).alias(c)
    return _differences(both.select(*KEY, there("old"), there("new")).where("old is not null or new is not null"))


def _differences(both: DataFrame) -> DataFrame:
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(~F.col("old").eqNullSafe(F.col("new")), "UPDATED")
    members = both.select(*KEY, change.alias("change")).where("change is not null")
    e = both.groupBy("edge_id").agg(F.max(F.col("old").isNotNull().cast("int")).alias("was"), F.max(F.col("new").isNotNull().cast("int")).alias("is"))
    edges = e.where("was <> is").select("edge_id", F.lit(None).cast("long").alias("member_id"), F.when(F.col("is") == 1, "CREATED").otherwise("DELETED").alias("change"))
    return members.union(edges)


def merge(base: DataFrame, source: DataFrame, target: DataFrame, on_conflict: str = "FAIL") -> tuple[DataFrame, DataFrame]:
    """Rows that bring a branch's work into its parent, and the conflicts (edge_id, member_id, conflict).

    membership: both sides changed it, even alike. deleted-while-modified: the branch took all members of an edge that the
    parent changed. modified-while-deleted: the other way round; such an edge stays away under any policy. FAIL raises on a
    conflict, SOURCE takes the branch's version, TARGET leaves the parent's. An ordered edge that the branch changed is taken
    as a whole, in the branch's order, unless one of its memberships stays the parent's.
    """
    if on_conflict not in ("FAIL", "SOURCE", "TARGET"):
        raise ValueError(on_conflict)
    sides = {"was": base, "theirs": source, "ours": target}
    tagged = [df.select(*KEY, F.lit(name).alias("side"), F.struct(*PAYLOAD).alias("row")) for name, df in sides.items()]
    # One shuffle by edge: memberships side by side, and what is said of their whole edge.
    rows = spread(tagged[0].union(tagged[1]).union(tagged[2]), "edge_id").groupBy(*KEY).agg(*[F.max(F.when(F.col("side") == name, F.col("row"))).alias(name) for name in sides])
    by = W.partitionBy("edge_id")
    some = lambda c: F.max(c).over(by)
    was, theirs, ours = (F.col(name) for name in sides)
    rows = rows.select("*", (~was.eqNullSafe(theirs)).alias("changed"), (~was.eqNullSafe(ours)).alias("touched"), F.coalesce("theirs", "was").alias("row"))
    there = lambda c: some(c.isNotNull())
    rows = rows.select("*", (there(was) & ~there(theirs)).alias("theirs_gone"), (there(was) & ~there(ours)).alias("ours_gone"), some(F.col("changed")).alias("any_changed"), some(F.col("touched")).alias("any_touched"), some(F.col("changed") & F.col("touched")).alias("any_both"), some(F.col("changed") & (F.col("row.kind") == "ORDERED")).alias("moved"))
    changed, touched, theirs_gone, ours_gone = (F.col(c) for c in ("changed", "touched", "theirs_gone", "ours_gone"))
    contested, deleted, modified = changed & touched & ~theirs_gone & ~ours_gone, theirs_gone & F.col("any_touched") & ~ours_gone, ours_gone & F.col("any_changed") & ~theirs_gone
    conflict = F.when(contested, "membership").when(deleted, "deleted-while-modified").when(modified, "modified-while-deleted")
    conflicts = rows.select("edge_id", F.when(contested, F.col("member_id")).alias("member_id"), conflict.alias("conflict")).where("conflict is not null").distinct()
    if on_conflict == "FAIL" and conflicts.limit(1).count():
        raise ValueError("both sides changed the same memberships or edges")
    taken = changed & ~ours_gone
    ordered = F.coalesce(F.col("moved"), F.lit(False)) & ~ours_gone & ~theirs_gone
    if on_conflict == "TARGET":
        taken = taken & ~contested & ~deleted & ~(F.col("any_both") & ordered)
        ordered = ordered & ~F.col("any_both")
    # What the parent holds of an edge that goes or comes whole and the branch doesn't have is removed, too.
    whole = ordered if on_conflict == "TARGET" else ordered | theirs_gone & ~ours_gone
    extra = whole & theirs.isNull() & ours.isNotNull()
    every = ordered & theirs.isNotNull()
    op = F.when(extra, "REMOVE").when(every, "PUT").when(~whole & taken, F.when(theirs.isNull(), "REMOVE").otherwise("PUT"))
    out = rows.select(*KEY, op.alias("op"), F.when(extra, ours).otherwise(F.col("row")).alias("row")).where("op is not null")
    return out.select(*KEY, "op", *[F.col(f"row.{c}").alias(c) for c in PAYLOAD]), conflicts


def merge_rows(base: DataFrame, source: DataFrame, target: DataFrame, key: list[str], on_conflict: str = "FAIL") -> tuple[DataFrame, DataFrame]:
    """`merge` for rows under a key, as properties are: op and the row; a conflict where both sides changed a key, but not alike."""
    fields = [c for c in base.columns if c not in key]
    packed = lambda df, name: df.select(*key, F.struct(F.lit(1).alias("there"), *fields).alias(name))
    all_ = packed(base, "was").join(packed(source, "theirs"), key, "full_outer").join(packed(target, "ours"), key, "full_outer")
    changed = all_.where(~F.col("was").eqNullSafe(F.col("theirs")) & ~F.col("theirs").eqNullSafe(F.col("ours")))
    contested = ~F.col("was").eqNullSafe(F.col("ours"))
    conflicts = changed.where(contested).select(*key)
    if on_conflict == "FAIL" and conflicts.limit(1).count():
        raise ValueError("both sides changed the same properties")
    taken = changed if on_conflict == "SOURCE" else changed.where(~contested)
    op = F.when(F.col("theirs").isNull(), "REMOVE").otherwise("PUT")
    return taken.select(op.alias("op"), *key, *[F.col(f"theirs.{c}").alias(c) for c in fields]), conflicts


def history(commits: DataFrame, n: int = 20) -> DataFrame:
    """The last n commits, newest first."""
    last = commits.agg(F.max("gen").alias("last"))
    return commits.join(F.broadcast(last)).where(F.col("gen") > F.col("last") - n).drop("last").orderBy(F.desc("gen"))


def member_changes(log: DataFrame) -> DataFrame:
    """Each log row as +1 or -1: a put that adds a membership, a removal of one that was there; 0 for an update."""
    by = W.partitionBy("branch", *KEY).orderBy("gen")
    before = F.coalesce(F.lag("op").over(by), F.lit("REMOVE"))
    delta = F.when((F.col("op") == "PUT") & (before == "REMOVE"), 1).when((F.col("op") == "REMOVE") & (before == "PUT"), -1).otherwise(0)
    return log.withColumn("delta", delta.cast("long"))
