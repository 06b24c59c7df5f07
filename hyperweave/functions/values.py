"""Expressions with two-valued truth: a comparison with a missing value is false, and so its negation is true."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def eq(a, b) -> Column:
    return known(column(a) == column(b))


def ne(a, b) -> Column:
    """True also where exactly one side is missing."""
    return ~column(a).eqNullSafe(column(b))


def lt(a, b) -> Column:
    return known(column(a) < column(b))


def le(a, b) -> Column:
    return known(column(a) <= column(b))


def gt(a, b) -> Column:
    return known(column(a) > column(b))


def ge(a, b) -> Column:
    return known(column(a) >= column(b))


def between(x, low, high) -> Column:
    """Inclusive; a missing lower bound is below everything, a missing upper bound or value is false."""
    low_, high_ = column(low), column(high)
    return known((low_.isNull() | (column(x) >= low_)) & (column(x) <= high_))


def truthy(x, kind: str = "number") -> Column:
    """Numbers other than 0, any text, and true."""
    c = column(x)
    return c.isNotNull() if kind == "text" else known(c) if kind == "bool" else known(c != 0)


def all_of(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def divide(a, b) -> Column:
    """Always a double; by zero an infinity or not-a-number, never an error."""
    x, y = column(a).cast("double"), column(b).cast("double")
    zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(y == 0, F.when(x.isNotNull(), zero)).otherwise(x / F.when(y != 0, y))


def rendered(x) -> Column:
    """Text of a value, `null` for a missing one."""
    return F.coalesce(column(x).cast("string"), F.lit("null"))


def lower(x) -> Column:
    return F.lower(rendered(x))


def upper(x) -> Column:
    return F.upper(rendered(x))


def length(x) -> Column:
    """In code points."""
    return F.length(rendered(x)).cast("long")


def json(x, path: str, kind: str = "string") -> Column:
    """First scalar that a path of `.field`, `[n]` and `[*]` selects in a JSON document, or null."""
    parsed = F.try_parse_json(column(x))
    if "[*]" not in path:
        return F.try_variant_get(parsed, path, kind)
    head, _, tail = path.partition("[*]")
    items = F.try_variant_get(parsed, head, "array<variant>")
    found = F.transform(items, lambda v: F.try_variant_get(v, "$" + tail, kind))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def bits(x: Column) -> Column:
    """Bucket of a histogram by powers of two: 0 for 0 and below, else the number of binary digits."""
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x))).cast("long")
