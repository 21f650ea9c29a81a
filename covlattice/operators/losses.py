"""Masked, weighted losses; every coverage type counts alike."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covlattice.functions.scalar import relative_error, relu, smooth_l1


@dataclass(frozen=True)
class RankConfig:
    margin: float = 0.05
    min_gap: float = 0.1

    def __post_init__(self) -> None:
        if self.margin < 0 or self.min_gap < 0:
            raise ValueError("margin and gap must not be negative")


def equal_type_mean(per_row: DataFrame, loss: str = "loss", by: str = "ctype") -> DataFrame:
    """Mean over types of the mean over a type's rows; 0 without rows.  One row: (loss, n_types)."""
    typed = per_row.groupBy(by).agg(F.avg(loss).alias("m"))
    return typed.agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("loss"), F.count("m").alias("n_types"))


def weighted_type_mean(per_row: DataFrame, loss: str = "loss", weight: str = "weight", by: str = "ctype", times: str | None = None) -> DataFrame:
    """As :func:`equal_type_mean` with the rows of a type weighted; the divisor is still their number.

    ``times`` names a column that says for how many equal rows a row stands.
    """
    n = F.lit(1) if times is None else F.col(times)
    bad = F.raise_error(F.lit("negative weight")).cast("double")
    weighted = F.col(loss) * F.when(F.col(weight) < 0, bad).otherwise(F.col(weight))
    typed = per_row.groupBy(by).agg((F.sum(weighted * n) / F.sum(n)).alias("m"))
    return typed.agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("loss"), F.count("m").alias("n_types"))


def weighted_graph_loss(
    rows: DataFrame, relative_weight: float = 0.1, floor: float = 0.1, by: str = "ctype", times: str | None = None
) -> DataFrame:
    """Smooth-L1 of the error plus a part for the relative error, times the row's weight.

    ``rows`` has pred, target, weight.  A type's loss is the sum over its rows
    with a target divided by their number, not by their weights.  A row stands
    for ``times`` equal ones.
    """
    if floor <= 0 or relative_weight < 0:
        raise ValueError("the floor must be positive and the weight not negative")
    weight = F.when(F.col("weight") < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(F.col("weight"))
    valid = rows.where(F.col("target").isNotNull() & ~F.isnan("target"))
    one = smooth_l1(F.col("pred") - F.col("target"))
    if relative_weight:
        one = one + relative_weight * smooth_l1(relative_error(F.col("pred"), F.col("target"), floor))
    n = F.count("*") if times is None else F.sum(times)
    if times is not None:
        weight, valid = weight * F.col(times), valid.where(F.col(times) > 0)
    typed = valid.groupBy(by).agg((F.sum(one * weight) / n).alias("m"), n.alias("n"))
    return typed.agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("loss"), F.count("*").alias("n_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_targets"))


def volume_loss(rows: DataFrame, dims: int, min_width: float = 1e-3, by: str = "ctype", times: str | None = None) -> DataFrame:
    """Smooth-L1 between log volume and log density (log_volume, density, size_mask, weight); a row stands for ``times`` equal ones."""
    low = min_width**dims
    wanted = F.ln(F.greatest(F.lit(low), F.least(F.lit(1.0), F.col("density"))))
    valid = rows.where("size_mask").withColumn("loss", smooth_l1(F.col("log_volume") - wanted))
    return weighted_type_mean(valid, by=by, times=times)


def iou_calibration(rows: DataFrame, by: str = "ctype", tiny: float = 1e-12, log_iou: str | None = None) -> DataFrame:
    """Smooth-L1 of the logs where the sets meet, squared IoU where they don't (iou, jaccard, iou_mask).

    ``log_iou`` names the log of a smooth IoU, which needs no floor.
    """
    log = F.ln(F.greatest("iou", F.lit(tiny))) if log_iou is None else F.col(log_iou)
    logs = log - F.ln(F.greatest("jaccard", F.lit(tiny)))
    one = F.when(F.col("jaccard") > 0, smooth_l1(logs)).otherwise(F.col("iou") * F.col("iou"))
    return equal_type_mean(rows.where("iou_mask").withColumn("loss", one), by=by)


def iou_rank_loss(rows: DataFrame, config: RankConfig = RankConfig(), batch: str = "batch", item: str = "item", by: str = "ctype") -> DataFrame:
    """Hinge on the order of two pairs of a batch whose targets differ enough; (loss, n_pairs, n_types).

    A batch has a bounded number of rows (its size is a setting), so its pairs are bounded too.
    """
    a = rows.where("iou_mask").select(batch, by, F.col(item).alias("i"), F.col("iou").alias("x"), F.col("jaccard").alias("s"))
    b = a.select(batch, by, F.col("i").alias("j"), F.col("x").alias("y"), F.col("s").alias("t"))
    met = a.join(b, [batch, by]).where("i < j")
    gap = F.col("s") - F.col("t")
    used = met.where((F.abs(gap) > 0) & (F.abs(gap) >= config.min_gap))
    one = relu(F.lit(config.margin) - F.signum(gap) * (F.col("x") - F.col("y")))
    typed = used.groupBy(by).agg(F.avg(one).alias("m"), F.count("*").alias("n"))
    return typed.agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("loss"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count("*").alias("n_types"))


def combined_geometry_loss(volume: DataFrame, iou: DataFrame, rank: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """One row of the three parts as their functions give them: loss, each part, its types, and the ordered pairs."""
    v = volume.select(F.col("loss").alias("volume"), F.col("n_types").alias("volume_types"))
    c = iou.select(F.col("loss").alias("iou"), F.col("n_types").alias("iou_types"))
    r = rank.select(F.col("loss").alias("rank"), F.col("n_types").alias("rank_types"), "n_pairs")
    met = v.join(F.broadcast(c)).join(F.broadcast(r))  # one row each
    return met.withColumn("loss", weights[0] * F.col("volume") + weights[1] * F.col("iou") + weights[2] * F.col("rank"))


def pair_graph_loss(a: Column, b: Column) -> Column:
    """Both ends of a pair are reduced on their own, then averaged."""
    return (a + b) / 2


def joint_loss(supervised: Column, iou: Column, volume: Column, weights: tuple[float, float, float], warm: Column | float = 1.0) -> Column:
    """Weighted total; ``warm`` scales the volume part while training begins."""
    return weights[0] * supervised + weights[1] * iou + weights[2] * warm * volume


def tail_scale(local_rows: Column, all_rows: Column, ranks: int) -> Column:
    """Factor that makes means of unequal shards average to the mean of all rows."""
    return F.try_divide(ranks * local_rows, all_rows)


def log_floor(value: Column, low: float) -> Column:
    return F.ln(F.greatest(value, F.lit(low)))


LOG_TINY = math.log(1e-12)
