"""Sums along the arrays of a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: what a lambda uses from outside is computed anew for each element otherwise."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, kind: str = "long", size: int = 64) -> Column:
    """The sum of the values (of a kind) before each one: within chunks, then over the chunks' totals, so a long array is not copied for each value."""

    def before(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0).cast(kind)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def moved(parts: Column) -> Column:
        starts = before(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.zip_with(parts, bound(starts, lambda s: F.slice(s, 1, F.size(s) - 1)), lambda p, at: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: v + at))

    def sums(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(a), F.lit(size)), lambda i: before(F.slice(a, i, size)))
        return F.when(F.size(a) <= size, bound(before(a), lambda p: F.slice(p, 1, F.size(p) - 1))).otherwise(F.flatten(bound(chunks, moved)))

    return bound(values, sums)
