"""Joins whose keys may be hot: a value or a node that very many rows have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covlattice.session import cut_lineage

#: Rows of numbers that are sent to every task at most.
BROADCAST_ROWS = 100_000
#: A key is hot if more than this part of the rows have it: fewer keys than this can.
HOT_PART = 1_000


def join_counted(rows: DataFrame, found: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined to ``found`` (keys, weight, ...), one row for each key; ``weight`` counts the rows that have it.

    A small ``found`` is broadcast.  Else the keys of more than a thousandth of
    the rows, fewer than a thousand, are, and the rest is joined by a shuffle in
    which no key is hot.  ``weight`` is dropped; null keys match none.
    """
    found = cut_lineage(found)
    n, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found.drop(weight)), keys)
    least = total / HOT_PART
    hot = F.broadcast(found.where(F.col(weight) > least).drop(weight))
    rest = rows.join(hot, keys, "left_anti").join(found.where(F.col(weight) <= least).drop(weight), keys)
    return rows.join(hot, keys).unionByName(rest)
