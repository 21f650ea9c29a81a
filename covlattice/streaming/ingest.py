"""Streams of sample files and metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from covlattice.functions.text import cache_key
from covlattice.sources import schemas


def stream_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Sample lines of the files that arrive in a folder; lines of another version are left out."""
    lines = spark.readStream.format("text").load(folder).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schemas.SAMPLE).alias("s")).select("s.*")
    return rows.where(F.col("schema_version") == schemas.SAMPLE_VERSION)


def new_texts(texts: DataFrame, fingerprint: str) -> DataFrame:
    """Texts of a stream (text, at) that were not seen in the last day, with their cache key."""
    keyed = texts.withColumn("content_key", cache_key(F.col("text"), fingerprint)).withWatermark("at", "1 day")
    return keyed.dropDuplicatesWithinWatermark(["content_key"])


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet until its input is used up."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def epoch_metrics(rows: DataFrame) -> DataFrame:
    """Running n, mse and mae of each epoch and type of a stream (epoch, ctype, pred, target)."""
    e = F.col("pred") - F.col("target")
    return rows.where("target is not null").groupBy("epoch", "ctype").agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
