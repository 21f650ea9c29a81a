"""Helpers that several operators share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covlattice.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage"]

#: White space of the word rule shared by the text operators.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of numbers that are sent to every task at most.
BROADCAST_ROWS = 200_000
#: A key is hot if more than this part of the rows have it.
HOT_KEYS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{stem}-{uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`shared_folder` named, through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is counted to hold no more than ``BROADCAST_ROWS`` rows.

    For written tables of a few numbers a row: 20 MB at most.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def left_join_skewed(rows: DataFrame, found: DataFrame, key: str, weight: str = "n") -> DataFrame:
    """``rows`` left-joined to ``found`` (key, weight, ...), whose ``weight`` says how many rows share its key.

    A small ``found`` is broadcast whole.  Else the keys that more than a
    thousandth of all rows have, fewer than a thousand, are broadcast, and the
    rest is joined by a shuffle, in which no key is hot.
    """
    if found.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found.drop(weight)), key, "left")
    least = rows.count() / HOT_KEYS
    hot = F.broadcast(found.where(F.col(weight) > least).drop(weight))
    rest = rows.join(hot, key, "left_anti").join(found.where(F.col(weight) <= least).drop(weight), key, "left")
    return rows.join(hot, key).unionByName(rest)


def _by_keys(docs: DataFrame, key: list[Column], keys: DataFrame, how: str) -> DataFrame:
    names = [fresh(docs, f"key{k}") for k in range(len(key))]
    on = [c.eqNullSafe(F.col(f"`{n}`")) for c, n in zip(key, names)]
    found = small(keys.toDF(*names))
    test = on[0]
    for one in on[1:]:
        test = test & one
    return docs.join(found, test, how)


def with_keys(docs: DataFrame, key: list[Column], keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` columns (nulls are equal) are a row of the written table ``keys``."""
    return _by_keys(docs, key, keys, "left_semi")


def without_keys(docs: DataFrame, key: list[Column], keys: DataFrame) -> DataFrame:
    """The other rows of ``docs``: few keys are broadcast, so that no document is shuffled."""
    return _by_keys(docs, key, keys, "left_anti")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that starts with ``stem`` and is not one of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    name, k = f"_{stem}", 0
    while name.lower() in taken:
        name, k = f"_{stem}{k}", k + 1
    return name
