"""A store of samples and graphs from which one sample is read without a scan.

Rows are sorted by a hash of their key and written as Parquet files that hold
ranges of it, in small row groups with a Bloom filter on the key; a catalogue
names the least and largest hash of every file.  A look-up asks the catalogue
for the one file, and the file's statistics and filter for the row group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from covlattice.session import cut_lineage

#: Bytes of a row group, and keys that its filter is made for.
GROUP_BYTES, FILTER_KEYS = 4 << 20, 100_000


class NotStored(LookupError):
    """The store holds no row of that key."""


def place(key: Column) -> Column:
    """Where a key lies: a hash, so that ranges are even whatever the keys are."""
    return F.xxhash64(key.cast("string"))


def write_keyed(rows: DataFrame, path: str, key: str, files: int | None = None) -> DataFrame:
    """Write ``rows`` under ``path`` and return the catalogue (file, low, high, n), which lies beside them.

    Rows of a null key are not stored; rows of one key lie in one file.
    """
    kept = rows.where(F.col(key).isNotNull()).withColumn("place_", place(F.col(key)))
    ranged = kept.repartitionByRange(files, "place_") if files else kept.repartitionByRange("place_")
    (
        ranged.sortWithinPartitions("place_", key).write.option("parquet.block.size", GROUP_BYTES)
        .option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", FILTER_KEYS)
        .mode("overwrite").parquet(f"{path}/rows")
    )
    spark = rows.sparkSession
    written = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file"))
    found = written.agg(F.min("place_").alias("low"), F.max("place_").alias("high"), F.count(F.lit(1)).alias("n"))
    found.coalesce(1).write.mode("overwrite").parquet(f"{path}/catalogue")  # a row for each file
    return spark.read.parquet(f"{path}/catalogue")


def files_of(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, file) of ``keys`` (key): the files that may hold them, by the catalogue alone."""
    listed = F.broadcast(spark.read.parquet(f"{path}/catalogue"))  # a row for each file
    return keys.join(listed, place(F.col("key")).between(F.col("low"), F.col("high"))).select("key", "file")


def read_keyed(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """The rows of one key: from one file, and of it the row groups that its statistics and filter leave."""
    one = spark.createDataFrame([(value,)], ["key"])
    names = [r.file for r in files_of(spark, path, one).collect()]  # one file, or two where a range ends
    rows = spark.read.parquet(*[f"{path}/rows/{n}" for n in names]) if names else spark.read.parquet(f"{path}/rows").limit(0)
    at = one.select(place(F.col("key"))).first()[0]
    return rows.where((F.col("place_") == at) & (F.col(key) == value)).drop("place_")


def read_sample(spark: SparkSession, samples: str, graphs: str, sample: object, key: str = "sample_id", refers: tuple[str, ...] = ("rtl_key", "asm_key")) -> tuple[Row, dict[str, Row | None]]:
    """A sample and the graphs it names by ``refers``, each from one look-up; a missing graph is None, a missing sample an error."""
    found = read_keyed(spark, samples, key, sample).limit(1).collect()
    if not found:
        raise NotStored(f"no sample {sample!r}")
    row, held = found[0], {}
    for name in refers:
        named = row[name]
        got = read_keyed(spark, graphs, "graph", named).limit(1).collect() if named is not None else []
        held[name] = got[0] if got else None
    return row, held


def read_many(spark: SparkSession, path: str, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of many keys (a table with the column ``key``), each once: of the files that can hold them only, met by the hash."""
    asked = cut_lineage(wanted.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct())
    names = [r.file for r in files_of(spark, path, asked).select("file").distinct().collect()]  # of the catalogue
    rows = spark.read.parquet(*[f"{path}/rows/{n}" for n in names]) if names else spark.read.parquet(f"{path}/rows").limit(0)
    return rows.join(asked.select(F.col("key").alias(key)), key, "left_semi").drop("place_")
