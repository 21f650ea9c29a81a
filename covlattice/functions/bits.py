"""Sets of small integers as arrays of 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0)


def bit(element: Column) -> Column:
    """The word of a single element, within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (element % 64).cast("int"))


def cardinality(words: Column) -> Column:
    return F.aggregate(words, _zero(), lambda n, w: n + F.bit_count(w).cast("int"))


def intersection_size(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.bit_count(F.coalesce(x, F.lit(0)).bitwiseAND(F.coalesce(y, F.lit(0)))))
    return F.aggregate(both, _zero(), lambda n, c: n + c.cast("int"))

