"""Scalar maths of losses, schedules and heads."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def smooth_l1(difference: Column) -> Column:
    """Quadratic below one, linear from there on."""
    size = F.abs(difference)
    return F.when(size < 1, 0.5 * difference * difference).otherwise(size - 0.5)


def relative_error(pred: Column, target: Column, floor: float) -> Column:
    return (pred - target) / F.greatest(F.abs(target), F.lit(floor))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column, sharpness: float = 1.0) -> Column:
    """ln(1 + e^(sharpness x)) / sharpness, written so that it can't overflow."""
    scaled = x * sharpness
    return (F.greatest(scaled, F.lit(0.0)) + F.log1p(F.exp(-F.abs(scaled)))) / sharpness


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def gelu(x: Column) -> Column:
    """x times the normal distribution, by a rational approximation of erf (error under 2e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    # fixed values: Abramowitz and Stegun 7.1.26
    series = 0.0
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        series = (series + c) * t if isinstance(series, Column) else c * t
    erf = 1 - series * F.exp(-z * z)
    return 0.5 * x * (1 + F.signum(x) * erf)


def width_code(width: Column) -> Column:
    return F.log2(width + 1)


def lr_factor(step: Column, total: int, warmup: int, kind: str = "cosine") -> Column:
    """Share of the base learning rate: linear warm-up over a tenth of the steps at most, then decay."""
    warm = min(warmup, int(total * 0.1))
    progress = (step - warm) / max(1, total - warm)
    if kind == "cosine":
        decay = 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    elif kind == "linear":
        decay = F.greatest(F.lit(0.0), 1 - progress)
    elif kind == "constant":
        decay = F.lit(1.0)
    else:
        raise ValueError(f"unknown schedule: {kind}")
    return F.when(step < warm, step / max(1, warm)).otherwise(decay)


def volume_warmup(epoch: Column, epochs: int) -> Column:
    return F.least(F.lit(1.0), epoch / epochs) if epochs > 0 else F.lit(1.0)


def drop_path_rate(layer: Column, rate: float, layers: int) -> Column:
    return rate * layer / max(1, layers - 1)


def to_number(value: Column) -> Column:
    """A metric as a double, or null where it is none."""
    return value.try_cast("double")


def softmax_row(values: Column) -> Column:
    """Softmax over the entries of an array."""
    top = F.array_max(values)
    shifted = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def layer_norm(values: Column, eps: float = 1e-5) -> Column:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean)) / n
    return F.transform(values, lambda v: (v - mean) / F.sqrt(var + eps))


def matvec(values: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """weights (out x in) times an array, plus bias."""
    rows = [
        F.aggregate(F.zip_with(values, F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
        + float(b)
        for row, b in zip(weights, bias or [0.0] * len(weights))
    ]
    return F.array(*rows)
