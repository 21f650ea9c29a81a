"""Orders over whole tables: running totals, positions, ranks and medians without one task for all rows.

Rows are sorted into ranges of the full order by Spark's range partitioning and
written once, so that the ranges stay what they are; totals within a range and
before it are then added.  The ranges grow in number with the rows, so that a
task's share does not, never in meaning: ties of the first column are split by
the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covlattice.session import tasks_for, written_once


def running_total(rows: DataFrame, order: list[str], amount: str, out: str, by: list[str] | None = None) -> DataFrame:
    """``rows`` with ``out``: the sum of ``amount`` over the rows before, in ``order`` and within ``by``.

    ``order`` should tell rows apart: equal ones come in any order and lie in one range.
    """
    keys = by or []
    rows = written_once(rows, "unordered")  # ranges are drawn from a sample, so rows are read twice
    parts = tasks_for(rows)
    ranged = written_once(rows.repartitionByRange(parts, *keys, *order).withColumn("range_", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*keys, "range_").agg(F.sum(amount).alias("sum_"))  # a row for each range of a group
    earlier = W.partitionBy(*keys).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    # written, or the rows would be shuffled as the few sums are: by ``by`` alone
    base = written_once(sums.select(*keys, "range_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("base_")), "bases")
    inner = W.partitionBy(*keys, "range_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.repartition(parts, *keys, "range_").withColumn("inner_", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return placed.join(base, [*keys, "range_"]).withColumn(out, F.col("base_") + F.col("inner_")).drop("range_", "base_", "inner_")


def positions(rows: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """``rows`` numbered from 0 in ``order``."""
    return running_total(rows.withColumn("one_", F.lit(1).cast("long")), order, "one_", out).drop("one_")


def value_counts(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, n_, before_): distinct values with their rows and the rows of smaller ones; nulls are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_"))
    return running_total(counts, [value], "n_", "before_", by)


def lower_medians(rows: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """(by, out): the smallest value that at least half of the rows do not exceed; groups of nulls only are left out.

    Without ``by`` there is one row, null for an empty table.
    """
    keys = by or []
    placed = value_counts(rows, value, keys)
    if not keys:
        all_ = placed.agg(F.sum("n_").alias("all_"))  # one row
        met = placed.join(F.broadcast(all_))
    else:
        met = placed.join(placed.groupBy(*keys).agg(F.sum("n_").alias("all_")), keys)
    return met.where(2 * (F.col("before_") + F.col("n_")) >= F.col("all_")).groupBy(*keys).agg(F.min(value).alias(out))
