"""A cache of encodings that two writers may add to and that heals itself.

A cache is a folder of parts.  A part is written whole beside the others and
then renamed to ``part-...``, so that a reader sees all of it or nothing, and a
writer never touches another's part: two that encode the same text add the same
entry twice, of which one counts.

Every entry carries a checksum of its vector.  An entry that does not match it,
has another length or holds a null or non-finite number is not read: it is
listed in ``quarantine`` with its reason and encoded anew, as is what an
unreadable file held.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covlattice.functions.text import cache_key
from covlattice.session import cut_lineage

ENTRY = "content_key string, vector array<double>, checksum long"


def checksum(vector: Column) -> Column:
    return F.xxhash64(vector)


def _fault(dims: int) -> Column:
    """Why an entry can't be used; null for a good one."""
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(F.col("content_key").isNull(), "no key").when(v.isNull(), "no vector").when(F.size(v) != dims, "another length")
        .when(~sound, "not finite").when(~F.coalesce(F.col("checksum") == checksum(v), F.lit(False)), "another checksum")
    )


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _parts(spark: SparkSession, cache: str) -> list[str]:
    fs, p = _folder(spark, cache)
    if not fs.exists(p):
        return []
    return sorted(f"{cache}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))


def read_entries(spark: SparkSession, cache: str) -> DataFrame:
    """All entries of the committed parts, good or not, with their file ``part``; unreadable files are passed over."""
    parts = _parts(spark, cache)
    if not parts:
        return spark.createDataFrame([], f"{ENTRY}, part string")
    files = [f"{p}/*.parquet" for p in parts]
    return spark.read.schema(ENTRY).option("ignoreCorruptFiles", "true").parquet(*files).withColumn("part", F.col("_metadata.file_path"))


def read_cache(spark: SparkSession, cache: str, dims: int) -> DataFrame:
    """(content_key, vector): one good entry for each key."""
    good = read_entries(spark, cache).where(_fault(dims).isNull())
    return good.groupBy("content_key").agg(F.min_by("vector", F.struct("checksum", "part")).alias("vector"))


def add_part(entries: DataFrame, cache: str, kind: str = "part") -> str:
    """Write (content_key, vector, ...) as a part of its own and commit it by renaming; the part's folder."""
    spark, name = entries.sparkSession, uuid.uuid4().hex
    entries.write.parquet(f"{cache}/_writing-{name}")
    fs, written = _folder(spark, f"{cache}/_writing-{name}")
    final = f"{cache}/{kind}-{name}"
    if not fs.rename(written, _folder(spark, final)[1]):
        raise OSError(f"{cache}: the part {name} could not be committed")
    return final


def quarantined(spark: SparkSession, cache: str) -> DataFrame:
    """(content_key, part, reason) of the entries that were found bad."""
    fs, p = _folder(spark, cache)
    listed = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    folders = [f"{cache}/{n}" for n in listed if n.startswith("quarantine-")]
    kind = "content_key string, part string, reason string"
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def encode_through(
    texts: DataFrame, cache: str, fingerprint: str, dims: int, encode: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(content_key, vector) of all ``texts`` (text); only what has no good entry is encoded.

    ``encode`` turns (content_key, text) into (content_key, vector).  Null texts
    have no key and are left out; a vector of ``encode`` that is no good entry
    is an error of the run, which then adds nothing.
    """
    spark = texts.sparkSession
    wanted = texts.where("text IS NOT NULL").select(cache_key(F.col("text"), fingerprint).alias("content_key"), "text").dropDuplicates(["content_key"])
    known = read_entries(spark, cache).withColumn("reason", _fault(dims))
    noted = quarantined(spark, cache).select("content_key", "part")
    bad = cut_lineage(known.where("reason IS NOT NULL").select("content_key", "part", "reason").join(noted, ["content_key", "part"], "left_anti"))
    if not bad.isEmpty():
        add_part(bad, cache, "quarantine")
    good = known.where("reason IS NULL").select("content_key").distinct()
    made = encode(wanted.join(good, "content_key", "left_anti")).select("content_key", "vector").withColumn("checksum", checksum(F.col("vector")))
    fault = _fault(dims)
    checked = F.when(fault.isNull(), F.col("checksum")).otherwise(F.raise_error(F.concat(F.lit("the encoder gave a vector with "), fault)).cast("long"))
    made = cut_lineage(made.withColumn("checksum", checked))
    if not made.isEmpty():
        add_part(made, cache)
    return wanted.select("content_key").join(read_cache(spark, cache, dims), "content_key")
