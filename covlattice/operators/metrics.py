"""Regression, geometry and rank metrics, by coverage type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covlattice.operators.joins import join_counted
from covlattice.operators.order import lower_medians, value_counts

EPS = 1e-8


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def pearson(x: str, y: str) -> Column:
    """r by sums, with a small term in the denominator; 0 for fewer than two rows."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - _div(sx * sy, n)
    vx = F.greatest(F.sum(F.col(x) * F.col(x)) - _div(sx * sx, n), F.lit(0.0))
    vy = F.greatest(F.sum(F.col(y) * F.col(y)) - _div(sy * sy, n), F.lit(0.0))
    return F.when(n < 2, F.lit(0.0)).otherwise(cov / (F.sqrt(vx * vy) + EPS))


def regression_metrics(rows: DataFrame, by: str = "ctype") -> DataFrame:
    """(by, n, mse, mae, rmse, smape, median_ae, mape, r2, pearson_r) over rows with a target.

    A missing target drops the row, a missing prediction makes the metrics of
    its group null.  The median is the lower one; MAPE looks at targets that
    are not zero; R2 of a constant target is 1 for a perfect fit and else 0.
    Sums are taken of centred targets, so that R2 does not cancel.
    """
    valid = rows.where(F.col("target").isNotNull() & ~F.isnan("target"))
    spoilt = F.bool_or(F.col("pred").isNull() | F.isnan("pred"))
    e = F.col("pred") - F.col("target")
    means = valid.groupBy(by).agg(F.avg("target").alias("t0"), F.avg("pred").alias("p0"))
    centred = valid.join(F.broadcast(means), by).withColumn("tc", F.col("target") - F.col("t0")).withColumn("pc", F.col("pred") - F.col("p0"))
    size = F.abs(e)
    big = F.abs("target") > EPS
    res, tot = F.sum(e * e), F.sum(F.col("tc") * F.col("tc"))
    out = centred.groupBy(by).agg(
        F.count("*").alias("n"),
        spoilt.alias("spoilt"),
        F.avg(e * e).alias("mse"),
        F.avg(size).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(2 * size / (F.abs("pred") + F.abs("target") + EPS))).alias("smape"),
        F.coalesce(100 * F.avg(F.when(big, size / F.abs("target"))), F.lit(0.0)).alias("mape"),
        F.when(tot > EPS, 1 - _div(res, tot)).when(res <= EPS, 1.0).otherwise(0.0).alias("r2"),
        F.when(F.count("*") < 2, 0.0).otherwise(F.sum(F.col("pc") * F.col("tc")) / (F.sqrt(F.sum(F.col("pc") * F.col("pc")) * tot) + EPS)).alias("pearson_r"),
    )
    medians = lower_medians(valid.select(by, size.alias("size_")), "size_", "median_ae", [by])
    names = ["mse", "mae", "rmse", "smape", "median_ae", "mape", "r2", "pearson_r"]
    return out.join(medians, by, "left").select(by, "n", *[F.when(~F.col("spoilt"), F.col(c)).alias(c) for c in names])


def average_ranks(rows: DataFrame, value: str, out: str, by: str | None = None) -> DataFrame:
    """``rows`` with the rank of a value; equal values share the mean of their ranks.

    Ranks come from the counts of the distinct values, not from a sort of the
    rows; a value that very many rows have is met by broadcast.
    """
    keys = [by] if by else []
    ranks = value_counts(rows, value, keys).select(*keys, value, "n_", (F.col("before_") + (F.col("n_") + 1) / 2.0).alias(out))
    return join_counted(rows, ranks, [*keys, value], "n_")


def spearman(rows: DataFrame, x: str, y: str, by: str = "ctype") -> DataFrame:
    """(by, n, spearman): 0 for fewer than two rows or a constant side."""
    ranked = average_ranks(average_ranks(rows, x, "rx", by), y, "ry", by)
    return ranked.groupBy(by).agg(
        F.count("*").alias("n"),
        F.when((F.count("*") < 2) | (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)), 0.0).otherwise(pearson("rx", "ry")).alias("spearman"),
    )


def masked_mean(value: Column, mask: Column) -> Column:
    """Mean of the values under the mask; 0 where there is none."""
    return F.sum(F.when(mask, value).otherwise(0.0)) / F.greatest(F.lit(1), F.count_if(mask))


def geometry_metrics(pairs: DataFrame) -> DataFrame:
    """One row of calibration metrics.

    ``pairs`` has volume_a, volume_b, density_a, density_b, size_mask, iou,
    jaccard, iou_mask, meet, and the boxes lo_a, hi_a, lo_b, hi_b.  Volumes
    count once for each end, boundaries once for each end and axis.
    """
    size, iou = F.col("size_mask"), F.col("iou_mask")
    err = F.col("iou") - F.col("jaccard")
    both = lambda x: (x("a") + x("b")) / 2
    share = lambda test: F.sum(F.size(F.filter(F.concat(*test), lambda v: v))) / F.sum(F.size(F.concat(*test)))
    low = [F.transform(c, lambda v: v < 0.01) for c in ("lo_a", "lo_b")]
    high = [F.transform(c, lambda v: v > 0.99) for c in ("hi_a", "hi_b")]
    return pairs.agg(
        masked_mean(both(lambda e: F.abs(F.col(f"volume_{e}") - F.col(f"density_{e}"))), size).alias("volume_mae"),
        masked_mean(err * err, iou).alias("iou_mse"),
        masked_mean(F.abs(err), iou).alias("iou_mae"),
        masked_mean(both(lambda e: F.col(f"volume_{e}")), size).alias("predicted_volume_mean"),
        masked_mean(both(lambda e: F.col(f"density_{e}")), size).alias("target_density_mean"),
        masked_mean(F.col("iou"), iou).alias("predicted_iou_mean"),
        masked_mean(F.col("jaccard"), iou).alias("target_jaccard_mean"),
        masked_mean((~F.col("meet")).cast("double"), iou & (F.col("jaccard") > 0)).alias("positive_pair_zero_intersection_ratio"),
        share(low).alias("min_boundary_saturation"),
        share(high).alias("max_boundary_saturation"),
    )


def metric_rows(metrics: DataFrame, stage: str, by: str = "ctype") -> DataFrame:
    """Long (stage, name, value): the type is a suffix where there are several."""
    names = [c for c in metrics.columns if c not in (by, "n")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")
    several = metrics.count() > 1
    name = F.concat_ws("_", "x.m", by) if several else F.col("x.m")
    return metrics.select(by, pairs).select(F.lit(stage).alias("stage"), name.alias("name"), F.col("x.v").alias("value"))
