"""Conjunctive patterns over hyperedges, compiled to one multi-way join.

Variables may bind the same atom unless `distinct` forbids it. Constraints are turned into equi-joins, filters on edge sizes,
and shared-member counts; the order of joins is Catalyst's matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweave.operators.overlap import overlap_join

_COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


@dataclass
class Pattern:
    """Constraints on named variables; any variable may be given a type."""

    types: dict[str, str | None] = field(default_factory=dict)
    members: dict[str, str] = field(default_factory=dict)
    links: list[tuple[str, str, str | None]] = field(default_factory=list)
    sizes: list[tuple[str, str, int]] = field(default_factory=list)
    shares: list[tuple[str, str, str, int]] = field(default_factory=list)
    subsets: list[tuple[str, str]] = field(default_factory=list)
    times: dict[str, int] = field(default_factory=dict)
    apart: list[tuple[str, str]] = field(default_factory=list)
    constants: dict[str, int] = field(default_factory=dict)

    def edge(self, name: str, type: str | None = None) -> Pattern:
        self.types[name] = type
        return self

    def typed(self, name: str, type: str) -> Pattern:
        """The variable binds atoms of the type alone, whether it stands for an edge or a member."""
        self.members[name] = type
        return self

    def contains(self, edge: str, member: str, role: str | None = None) -> Pattern:
        self.links.append((edge, member, role))
        self.types.setdefault(edge, None)
        return self

    def card(self, edge: str, op: str, n: int) -> Pattern:
        self.sizes.append((edge, op, n))
        self.types.setdefault(edge, None)
        return self

    def shared(self, a: str, b: str, op: str, n: int) -> Pattern:
        self.shares.append((a, b, op, n))
        return self.edge(a, self.types.get(a)).edge(b, self.types.get(b))

    def subset(self, a: str, b: str) -> Pattern:
        self.subsets.append((a, b))
        return self.edge(a, self.types.get(a)).edge(b, self.types.get(b))

    def valid_at(self, edge: str, t: int) -> Pattern:
        self.times[edge] = t
        self.types.setdefault(edge, None)
        return self

    def distinct(self, a: str, b: str) -> Pattern:
        self.apart.append((a, b))
        return self

    def bind(self, name: str, atom: int) -> Pattern:
        self.constants[name] = atom
        return self


def _incidence(inc: DataFrame, p: Pattern, edge: str, timed: bool = True) -> DataFrame:
    rows = inc
    if p.types.get(edge):
        rows = rows.where(F.col("type") == p.types[edge])
    if timed and edge in p.times:
        t = p.times[edge]
        rows = rows.where((F.col("valid_from") <= t) & (F.col("valid_to") > t))
    if edge in p.constants:
        rows = rows.where(F.col("edge_id") == p.constants[edge])
    return rows


def _met(inc: DataFrame, p: Pattern, a: str, b: str) -> DataFrame:
    """Rows (a, b) for each member that two edges share; what is bound or must differ is cut before pairs are made or counted."""
    left, right = (_incidence(inc, p, e, timed=False).select(F.col("edge_id").alias(e), "member_id") for e in (a, b))
    met = left.join(right, "member_id").select(a, b)
    return met.where(F.col(a) != F.col(b)) if (a, b) in p.apart or (b, a) in p.apart else met


def _alike(p: Pattern, a: str, b: str) -> bool:
    """Whether two variables stand for the same edges, none of them bound."""
    return a != b and p.types.get(a) == p.types.get(b) and not {a, b} & set(p.constants)


def _overlaps(inc: DataFrame, p: Pattern, a: str, b: str) -> DataFrame:
    """Rows (a, b, n) for edges that share at least two members, both ways round, and an edge with itself where it may be."""
    rows = _incidence(inc, p, a, timed=False)
    pair = lambda x, y: F.struct(F.col(x).alias(a), F.col(y).alias(b), F.col("overlap").alias("n"))
    out = overlap_join(rows, 2).select(F.explode(F.array(pair("left", "right"), pair("right", "left"))).alias("r")).select("r.*")
    if (a, b) in p.apart or (b, a) in p.apart:
        return out
    own = rows.where("member_id is not null").groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1")
    return out.union(own.select("edge_id", "edge_id", "n"))


def match(inc: DataFrame, p: Pattern, atoms: DataFrame | None = None, product: bool = False) -> DataFrame:
    """Distinct bindings, one column for each variable. A type that no edge has matches nothing.

    atoms (atom_id, type) says the types of members. A pattern whose variables fall into unconnected parts has as many matches
    as the product of the parts', so it is an error unless `product` asks for it.
    """
    if p.members and atoms is None:
        raise ValueError("types of members need the table of atoms")
    parts: list[DataFrame] = []
    for edge, member, role in p.links:
        rows = _incidence(inc, p, edge)
        if role is not None:
            rows = rows.where(F.array_contains("roles", role))
        if member in p.constants:
            rows = rows.where(F.col("member_id") == p.constants[member])
        parts.append(rows.select(F.col("edge_id").alias(edge), F.col("member_id").alias(member)).distinct())
    for a, b, op, n in p.shares:
        # Edges that share one member are too many to be listed where they don't count.
        counted = _overlaps(inc, p, a, b) if _alike(p, a, b) and not getattr(1, _COMPARE[op])(n) else _met(inc, p, a, b).groupBy(a, b).agg(F.count("*").alias("n"))
        parts.append(counted.where(getattr(F.col("n"), _COMPARE[op])(n)).select(a, b))
    for a, b in p.subsets:
        size = _incidence(inc, p, a, timed=False).groupBy(F.col("edge_id").alias(a)).agg(F.count("*").alias("size"))
        if _alike(p, a, b):
            rows = _incidence(inc, p, a, timed=False)
            single = rows.groupBy("edge_id").agg(F.count("*").alias("n"), F.first("member_id").alias("member_id")).where("n = 1").select(F.col("edge_id").alias(a), "member_id")
            within = single.join(rows.select(F.col("edge_id").alias(b), "member_id"), "member_id").select(a, b)
            if (a, b) in p.apart or (b, a) in p.apart:
                within = within.where(F.col(a) != F.col(b))
            parts.append(_overlaps(inc, p, a, b).join(size, a).where("n = size").select(a, b).union(within))
            continue
        parts.append(_met(inc, p, a, b).groupBy(a, b).agg(F.count("*").alias("n")).join(size, a).where("n = size").select(a, b))
    for edge in sorted({e for e, *_ in p.sizes}):
        rows = inc.where(F.col("type") == p.types[edge]) if p.types.get(edge) else inc
        sizes = rows.groupBy(F.col("edge_id").alias(edge)).agg(F.count("*").alias("n"))
        for e, op, n in p.sizes:
            if e == edge:
                sizes = sizes.where(getattr(F.col("n"), _COMPARE[op])(n))
        parts.append(sizes.select(edge))
    for edge in p.types:
        if not any(edge in part.columns for part in parts) or edge in p.times and not any(edge == e for e, *_ in p.links):
            parts.append(_incidence(inc, p, edge).select(F.col("edge_id").alias(edge)).distinct())
    for name, kind in p.members.items():
        parts.append(atoms.where(F.col("type") == kind).select(F.col("atom_id").alias(name)).distinct())  # type: ignore[union-attr]
    # Join what is connected first.
    out = parts.pop(0)
    while parts:
        near = next((x for x in parts if set(x.columns) & set(out.columns)), parts[0])
        if not product and not set(near.columns) & set(out.columns):
            raise ValueError(f"nothing connects {', '.join(near.columns)} to {', '.join(out.columns)}")
        parts.remove(near)
        on = [c for c in near.columns if c in out.columns]
        out = out.join(near, on) if on else out.crossJoin(near)
    for name, atom in p.constants.items():
        if name in out.columns:
            out = out.where(F.col(name) == atom)
    for a, b in p.apart:
        out = out.where(F.col(a) != F.col(b))
    return out.distinct()
