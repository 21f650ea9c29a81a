"""Writers: graph tables, labelled samples, encoding cache, metric history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covlattice.functions.text import cache_key


def write_graphs(graphs: DataFrame, path: str) -> None:
    """Each graph once, under its key."""
    graphs.dropDuplicates(["graph"]).write.mode("overwrite").parquet(path)


def write_with_quarantine(rows: DataFrame, good: str, path: str, quarantine: str) -> None:
    """Rows for which the column ``good`` is true, and the others beside them."""
    ok = F.coalesce(F.col(good), F.lit(False))
    rows.where(ok).drop(good).write.mode("overwrite").parquet(path)
    rows.where(~ok).drop(good).write.mode("overwrite").parquet(quarantine)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_encodings(
    texts: DataFrame, cache: str, fingerprint: str, encode: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(content_key, vector) of all ``texts`` (text), encoding only what the cache lacks.

    ``encode`` turns (content_key, text) into (content_key, vector).  New
    vectors are appended by Spark's commit, so a broken run adds nothing.
    """
    spark = texts.sparkSession
    wanted = texts.select(cache_key(F.col("text"), fingerprint).alias("content_key"), "text").dropDuplicates(["content_key"])
    if exists(spark, cache):
        wanted = wanted.join(spark.read.parquet(cache), "content_key", "left_anti")
    encode(wanted).select("content_key", "vector").write.mode("append").parquet(cache)
    return spark.read.parquet(cache)


def append_metrics(metrics: DataFrame, path: str, epoch: int, step: int) -> None:
    """Rows (stage, name, value) of an epoch, appended to the history."""
    metrics.select(F.lit(epoch).alias("epoch"), F.lit(step).alias("step"), "stage", "name", F.col("value").try_cast("double").alias("value")).write.mode(
        "append"
    ).parquet(path)


def latest_metrics(history: DataFrame) -> DataFrame:
    """The history with one row for each epoch, stage and name: the one of the latest step, then the largest value."""
    last = F.max(F.struct("step", "value")).alias("m")
    return history.groupBy("epoch", "stage", "name").agg(last).select("epoch", "m.step", "stage", "name", "m.value")


def best_checkpoints(history: DataFrame, monitor: str, top: int, largest: bool = False) -> DataFrame:
    """The ``top`` epochs by a monitored metric; ties go to the earlier epoch."""
    value = F.col("value").desc() if largest else F.col("value").asc()
    return history.where(F.col("name") == monitor).orderBy(value, "epoch").limit(top)


def early_stop(history: DataFrame, monitor: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """One row (stop_epoch): the first epoch with ``patience`` epochs in a row that do not improve; null if none.

    An epoch improves if it is below the best before it by more than ``min_delta``.
    """
    rows = history.where(F.col("name") == monitor).agg(F.array_sort(F.collect_list(F.struct("epoch", "value"))).alias("h"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stop"))

    def step(a, x):
        better = x["value"] < a["best"] - min_delta
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        return F.struct(
            F.when(better, x["value"]).otherwise(a["best"]).alias("best"),
            bad.alias("bad"),
            F.coalesce(a["stop"], F.when(bad >= patience, x["epoch"].cast("int"))).alias("stop"),
        )

    return rows.select(F.aggregate("h", start, step, lambda a: a["stop"]).alias("stop_epoch"))


def plateau_rates(history: DataFrame, monitor: str, patience: int, factor: float = 0.1, min_delta: float = 0.0) -> DataFrame:
    """(epoch, rate): share of the base learning rate after each epoch.

    The rate is multiplied by ``factor`` when more than ``patience`` epochs in a
    row did not improve on the best, and the count starts anew.  A history has
    a row for each epoch, so the fold is over as many.
    """
    rows = history.where(F.col("name") == monitor).agg(F.array_sort(F.collect_list(F.struct("epoch", "value"))).alias("h"))
    out = F.array().cast("array<struct<epoch: int, rate: double>>")
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(1.0).alias("rate"), out.alias("out"))

    def step(a, x):
        better = x["value"] < a["best"] - min_delta
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        cut = bad > patience
        rate = F.when(cut, a["rate"] * factor).otherwise(a["rate"])
        row = F.struct(x["epoch"].cast("int").alias("epoch"), rate.alias("rate"))
        return F.struct(
            F.when(better, x["value"]).otherwise(a["best"]).alias("best"), F.when(cut, 0).otherwise(bad).alias("bad"),
            rate.alias("rate"), F.concat(a["out"], F.array(row)).alias("out"),
        )

    return rows.select(F.inline(F.aggregate("h", start, step, lambda a: a["out"])))
