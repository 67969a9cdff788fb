"""Column predicates by operator name, with standard semantics.

They are plain boolean columns: Catalyst pushes them to the scan and fuses them with whatever
follows, so a "mask" is never materialised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric_mask(column: str, op: str, value: float, upper: float | None = None) -> Column:
    """``= != < > <= >= between`` on a numeric column."""
    c = F.col(column)
    tests = {"=": c == value, "!=": c != value, "<": c < value, ">": c > value, "<=": c <= value, ">=": c >= value}
    if op == "between":
        return c.between(value, upper)
    if op not in tests:
        raise ValueError(f"unknown operator {op!r}")
    return tests[op]


def string_mask(column: str, op: str, value: str | list[str], ignore_case: bool = False) -> Column:
    """``= != in like`` on a string column; like is standard, or case-insensitive on request."""
    c = F.col(column)
    if op == "in":
        return c.isin(list(value))
    if op == "like":
        return c.ilike(value) if ignore_case else c.like(value)
    if op in ("=", "!="):
        return (c == value) if op == "=" else (c != value)
    raise ValueError(f"unknown operator {op!r}")


def all_of(*masks: Column) -> Column:
    return reduce(Column.__and__, masks)


def any_of(*masks: Column) -> Column:
    return reduce(Column.__or__, masks)


def none_of(mask: Column) -> Column:
    return ~mask


def ratio(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    """Division that yields null (or ``otherwise``) for a zero denominator."""
    out = F.try_divide(numerator, denominator)
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def position(column: Column, order: list[str]) -> Column:
    """Place in a fixed order, from 1; 0 for other values."""
    return F.array_position(F.array(*(F.lit(x) for x in order)), column)


def money(column: Column) -> Column:
    """Exact decimal for sums whose order of addition must not matter."""
    return column.cast("decimal(18,2)")
