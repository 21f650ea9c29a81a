"""Prediction records: checks, key joins and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covlattice.operators.geometry import log_product, widths


def _check(ok: Column, message: str, value: Column, kind: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def require_unique(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """The same rows; a repeated key is an error when they are read."""
    twice = samples.groupBy(key).agg(F.count("*").alias("n_"))
    met = samples.join(twice, key)
    return met.withColumn(key, _check(F.col("n_") == 1, "a sample id is repeated", F.col(key), "string")).drop("n_")


def prediction_records(outputs: DataFrame) -> DataFrame:
    """(sample_id, coverage, coverage_space, mean_volume) from (sample_id, coverage, ctype, lo, hi).

    ``coverage`` maps types to finite numbers; every box has finite ends, the
    lower not above the upper, on as many axes as its other end.  Anything else
    is an error.
    """
    finite = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = (F.size("lo") == F.size("hi")) & (F.size("lo") > 0) & finite("lo") & finite("hi")
    ordered = F.forall(F.zip_with("lo", "hi", lambda a, b: a <= b), lambda v: v)
    log_volume = log_product(widths(F.col("lo"), F.col("hi")))
    box = F.struct(F.col("lo").alias("min"), F.col("hi").alias("max"), F.exp(log_volume).alias("volume"))
    kind = "struct<min: array<double>, max: array<double>, volume: double>"
    checked = outputs.select(
        "sample_id",
        _check(finite(F.map_values("coverage")) & (F.size("coverage") > 0), "a predicted coverage is not a finite number", F.col("coverage"), "map<string, double>").alias("coverage"),
        "ctype",
        _check(good & ordered, "a box is not finite or its ends are in the wrong order", box.cast(kind), kind).alias("box"),
    )
    grouped = checked.groupBy("sample_id").agg(
        F.first("coverage").alias("coverage"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ctype", "box")))).alias("coverage_space"),
        F.avg("box.volume").alias("mean_volume"),
    )
    return grouped


def match_predictions(candidates: DataFrame, records: DataFrame, key: str = "sample_id") -> DataFrame:
    """Candidates with their records, by key; a candidate without one is an error."""
    met = candidates.join(records.withColumn("found_", F.lit(True)), key, "left")
    return met.withColumn(key, _check(F.col("found_"), "a candidate has no prediction", F.col(key), "string")).drop("found_")


def write_records(records: DataFrame, path: str) -> None:
    """One JSON line for each record, characters beyond ASCII escaped."""
    line = F.to_json(F.struct(*records.columns))
    # a character above U+FFFF is two escapes, as its UTF-16 units
    units = F.expr("transform(split(line, ''), c -> CASE WHEN c RLIKE '[^\\\\x00-\\\\x7F]' THEN regexp_replace(hex(encode(c, 'UTF-16BE')), '(....)', '\\\\\\\\u$1') ELSE c END)")
    records.select(line.alias("line")).select(F.array_join(units, "").alias("value")).write.text(path)
