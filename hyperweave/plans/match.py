"""MATCH: one variable over one type, with conditions, projections, aggregates, an order and a limit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperweave.operators.algebra import containing


@dataclass(frozen=True)
class Match:
    """A plan over a wide view of a type (atom_id, type and properties) and the incidences; each step returns a new plan."""

    view: DataFrame
    inc: DataFrame
    by: Column | None = None
    descending: bool = False
    most: int | None = None

    def _view(self, view: DataFrame) -> Match:
        return replace(self, view=view)

    def where(self, condition: Column) -> Match:
        return self._view(self.view.where(condition))

    def _semi(self, ids: DataFrame, name: str) -> Match:
        return self._view(self.view.join(ids.select(F.col(name).alias("atom_id")), "atom_id", "left_semi"))

    def contains(self, *members: int | tuple[int, list[str]]) -> Match:
        """Edges with all members, each optionally in all of some roles."""
        return self._semi(containing(self.inc, list(members)), "edge_id")

    def has(self, member: int, role: str) -> Match:
        return self.contains((member, [role]))

    def member_of(self, edge: int) -> Match:
        return self._semi(self.inc.where(F.col("edge_id") == edge), "member_id")

    def valid_at(self, t: int) -> Match:
        """Edges with a member valid then, and atoms with a membership valid then."""
        rows = self.inc.where((F.col("valid_from") <= t) & (F.col("valid_to") > t))
        ids = rows.select(F.explode(F.array("edge_id", "member_id")).alias("id")).distinct()
        return self._semi(ids, "id")

    def similar(self, nearest: DataFrame) -> Match:
        """Atoms among the nearest of all atoms, which are chosen before any other condition."""
        return self._semi(nearest, "atom_id")

    def _count(self, key: str, name: str, value: Column) -> Match:
        sums = self.inc.groupBy(F.col(key).alias("atom_id")).agg(value.alias(name))
        return self._view(self.view.join(sums, "atom_id", "left").fillna(0, [name]))

    def with_card(self) -> Match:
        return self._count("edge_id", "card", F.count("*"))

    def with_degree(self) -> Match:
        return self._count("member_id", "degree", F.count("*"))

    def with_weight(self) -> Match:
        return self._count("edge_id", "weight", F.sum("weight_fp") / F.lit(1e9))

    def order_by(self, by: Column, descending: bool = False) -> Match:
        return replace(self, by=by, descending=descending)

    def limit(self, n: int) -> Match:
        return replace(self, most=n)

    def _order(self) -> list[Column]:
        """Missing values are lowest; equal ones keep the scan's order, which is by id."""
        if self.by is None:
            return [F.col("atom_id")]
        return [self.by.desc_nulls_last() if self.descending else self.by.asc_nulls_first(), F.col("atom_id")]

    def returns(self, **columns: Column) -> DataFrame:
        rows = self.view
        if self.by is not None or self.most is not None:
            rows = rows.orderBy(*self._order())
        if self.most is not None:
            rows = rows.limit(self.most)
        return rows.select(*[c.alias(n) for n, c in columns.items()] or [F.col("atom_id")])

    def aggregates(self, aggregates: dict[str, Column], first: dict[str, Column] | None = None) -> DataFrame:
        """One row; plain projections beside aggregates come from the first row in order, and the limit doesn't matter."""
        key = F.col("atom_id") if self.by is None else F.struct(*self._keys())
        least = F.max_by if self.by is not None and self.descending else F.min_by
        plain = [least(c, key).alias(n) for n, c in (first or {}).items()]
        return self.view.agg(*[c.alias(n) for n, c in aggregates.items()], *plain)

    def _keys(self) -> list[Column]:
        if self.descending:
            return [self.by.isNotNull(), self.by, -F.col("atom_id")]  # type: ignore[union-attr,list-item]
        return [self.by.isNotNull(), self.by, F.col("atom_id")]  # type: ignore[union-attr,list-item]
