"""Ranked retrieval of edges by members in roles, times, attributes and size."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slot:
    """What an edge should hold: an atom, any atom of a type, or of a range of ids; accepted roles (none: all); weight; whether it must."""

    atom: int | None = None
    low: int | None = None
    high: int | None = None
    type: str | None = None
    roles: tuple[str, ...] = ()
    weight: float = 1.0
    required: bool = False


@dataclass(frozen=True)
class Preference:
    """An attribute near a value: exact without a scale, else falling off linearly over it."""

    name: str
    value: float | str
    scale: float | None = None
    weight: float = 1.0


#: Weights of members, roles, attributes, time and topology.
PARTS = {"members": 0.3, "roles": 0.2, "attributes": 0.2, "time": 0.2, "topology": 0.1}


def _time(at: int | None, tau: float, during: tuple[int, int] | None) -> Column:
    low, high = F.col("valid_from"), F.col("valid_to")
    if at is not None:
        gap = F.when(F.lit(at) < low, low - F.lit(at)).otherwise(F.lit(at) - (high - 1)).cast("double")
        return F.when((low <= at) & (high > at), 1.0).otherwise(F.exp(-gap / tau) if tau > 0 else F.lit(0.0))
    begin, end = during  # type: ignore[misc]
    inside = F.least(high, F.lit(end)) - F.greatest(low, F.lit(begin))
    return F.greatest(inside, F.lit(0).cast("long")).cast("double") / float(end - begin)


def rank(inc: DataFrame, slots: list[Slot], edges: DataFrame | None = None, at: int | None = None, tau: float = 0.0, during: tuple[int, int] | None = None, prefer: list[Preference] = (), size: int | None = None, top: int = 10, weights: dict[str, float] = PARTS, atoms: DataFrame | None = None) -> DataFrame:  # type: ignore[assignment]
    """edge_id, score and its parts (null where unused), the best `top` by score, then id.

    All slots are filled in one aggregation over the incidences; edges that lack a required slot go, those without a required
    atom before anything is grouped. Parts that aren't asked for have weight 0 and the other weights are scaled up to 1.
    atoms (atom_id, type) is needed for slots of any atom of a type.
    """
    if not 1 <= len(slots) <= 16 or len(prefer) > 16 or not 1 <= top <= 10_000 or any(not 0 < s.weight <= 1e6 for s in slots):
        raise ValueError("1 to 16 slots with weights up to a million, up to 16 preferences, top from 1 to 10000")
    timed = at is not None or during is not None
    when = _time(at, tau, during) if timed else F.lit(1.0)
    for must in {s.atom for s in slots if s.required and s.atom is not None}:
        inc = inc.join(inc.where(F.col("member_id") == must).select("edge_id").distinct(), "edge_id", "left_semi")
    kinds = sorted({s.type for s in slots if s.type is not None})
    if kinds:
        if atoms is None:
            raise ValueError("slots of a type need the table of atoms")
        inc = inc.join(atoms.where(F.col("type").isin(*kinds)).select(F.col("atom_id").alias("member_id"), F.col("type").alias("member_type")), "member_id", "left")
    fills = []
    for i, s in enumerate(slots):
        here = F.col("member_id") == s.atom if s.atom is not None else F.col("member_type") == s.type if s.type is not None else F.col("member_id").between(s.low, s.high)
        role = reduce(Column.__or__, [F.array_contains("roles", r) for r in s.roles], F.lit(False)) if s.roles else F.lit(True)
        # Plain numbers, as an aggregation of structs has to sort all rows.
        fills.append(F.max(F.when(here, F.when(role, 2).otherwise(1))).alias(f"slot{i}"))
        if timed:
            fills += [F.max(F.when(here & role, when)).alias(f"fit{i}"), F.max(F.when(here, when)).alias(f"time{i}")]
    filled = inc.groupBy("edge_id").agg(F.count("*").alias("n"), *fills)
    for i, s in enumerate(slots):
        if s.required:
            filled = filled.where(F.coalesce(f"slot{i}", F.lit(0)) == 2)
    total = sum(s.weight for s in slots)
    add = lambda xs: reduce(Column.__add__, xs)
    got = [F.coalesce(f"slot{i}", F.lit(0)) for i in range(len(slots))]
    share = lambda least: add([F.when(g >= least, s.weight).otherwise(0.0) for g, s in zip(got, slots, strict=True)])
    parts: dict[str, Column] = {"members": share(1) / total, "roles": share(2) / total}
    if timed:
        held = add([F.when(g > 0, s.weight * F.when(g == 2, F.col(f"fit{i}")).otherwise(F.col(f"time{i}"))).otherwise(0.0) for i, (g, s) in enumerate(zip(got, slots, strict=True))])
        parts["time"] = F.when(share(1) > 0, held / share(1)).otherwise(0.0)
    if prefer:
        filled = filled.join(edges.withColumnRenamed("atom_id", "edge_id").select("edge_id", *{p.name for p in prefer}), "edge_id", "left")  # type: ignore[union-attr]
        like = [F.coalesce((F.col(p.name) == p.value).cast("double") if p.scale is None else F.greatest(F.lit(0.0), 1 - F.abs(F.col(p.name) - p.value) / p.scale), F.lit(0.0)) * p.weight for p in prefer]
        parts["attributes"] = add(like) / sum(p.weight for p in prefer)
    if size is not None:
        parts["topology"] = F.least("n", F.lit(size)) / F.greatest("n", F.lit(size)).cast("double")
    scale = sum(weights[k] for k in parts)
    score = add([c * (weights[k] / scale) for k, c in parts.items()])
    null = F.lit(None).cast("double")
    return filled.select("edge_id", score.alias("score"), *[parts.get(k, null).alias(k) for k in PARTS]).orderBy(F.desc("score"), "edge_id").limit(top)
