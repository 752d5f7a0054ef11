"""Expressions over arrays that follow each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers in a slice whose running sums are taken one by one; the sums of the slices follow.
_SLICE = 256


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it: lambdas share no subexpressions."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running_starts(lengths: Column) -> Column:
    """Where each of an array's pieces starts if they follow each other: the sums of the lengths before it."""
    def follow(first: Column, xs: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))

    def slices(xs: Column) -> Column:
        n = F.ceil(F.size(xs) / F.lit(_SLICE)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(xs, k * _SLICE + 1, F.lit(_SLICE)))).otherwise(F.array().cast("array<array<bigint>>"))

    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    bases = lambda parts: follow(F.lit(0).cast("long"), F.transform(parts, total))
    whole = lambda parts: once(bases(parts), lambda b: F.flatten(F.transform(parts, lambda p, k: F.slice(follow(F.get(b, k), p), F.lit(1), F.size(p)))))
    return once(slices(lengths.cast("array<bigint>")), whole)
