import glob
import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from covlattice.functions.text import cache_key
from covlattice.sources import cache, store


def encode(calls, mark=1.0):
    def run(rows):
        calls.append({r.text for r in rows.select("text").collect()})
        return rows.select("content_key", F.array(F.length("text").cast("double"), F.lit(mark)).alias("vector"))

    return run


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(t,) for t in ["a", "bb", "ccc", "a", None, ""]], "text string")


def vectors(df):
    return sorted(r.vector for r in df.collect())


def test_only_what_is_missing_is_encoded(spark, texts, tmp_path):
    calls = []
    first = cache.encode_through(texts.where("text <> 'bb'"), f"{tmp_path}/c", "f", 2, encode(calls))
    assert vectors(first) == [[0.0, 1.0], [1.0, 1.0], [3.0, 1.0]]
    again = cache.encode_through(texts, f"{tmp_path}/c", "f", 2, encode(calls, 2.0))
    assert calls == [{"a", "ccc", ""}, {"bb"}] and vectors(again) == [[0.0, 1.0], [1.0, 1.0], [2.0, 2.0], [3.0, 1.0]]
    other = cache.encode_through(texts, f"{tmp_path}/c", "another model", 2, encode(calls, 3.0))
    assert calls[-1] == {"a", "bb", "ccc", ""} and all(v[1] == 3.0 for v in vectors(other))


def test_two_writers_and_a_broken_one(spark, texts, tmp_path):
    """Both add the same keys, an unfinished part lies beside them: every key is there once."""
    path, calls = f"{tmp_path}/c", []
    key = texts.select(cache_key(F.col("text"), "f").alias("content_key")).where("content_key IS NOT NULL").distinct()
    for mark in (1.0, 2.0):
        made = key.select("content_key", F.array(F.lit(5.0), F.lit(mark)).alias("vector"))
        cache.add_part(made.withColumn("checksum", cache.checksum(F.col("vector"))), path)
    shutil.copytree(glob.glob(f"{path}/part-*")[0], f"{path}/_writing-x")
    got = cache.encode_through(texts, path, "f", 2, encode(calls))
    assert calls == [set()] and got.count() == 4 and got.select("content_key").distinct().count() == 4
    assert len(glob.glob(f"{path}/part-*")) == 2


def test_broken_files_and_entries_heal(spark, texts, tmp_path):
    path, calls = f"{tmp_path}/c", []
    cache.encode_through(texts, path, "f", 2, encode(calls))
    for f in glob.glob(f"{path}/part-*/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"no parquet")
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    good = cache.encode_through(texts, path, "f", 2, encode(calls, 2.0))
    assert calls[1] == {"a", "bb", "ccc", ""} and all(v[1] == 2.0 for v in vectors(good))
    key = texts.where("text = 'bb'").select(cache_key(F.col("text"), "f").alias("content_key"))
    bad = [F.lit(None).cast("array<double>"), F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(None).cast("double")), F.array(F.lit(9.0), F.lit(9.0))]
    for k, v in enumerate(bad):
        cache.add_part(key.select("content_key", v.alias("vector"), F.lit(k).cast("long").alias("checksum")), path)
    assert vectors(cache.encode_through(texts, path, "f", 2, encode(calls, 3.0))) == vectors(good)  # the good entry is still there
    for _ in range(2):
        cache.encode_through(texts, path, "f", 2, encode(calls, 3.0))
    assert sorted(r.reason for r in cache.quarantined(spark, path).collect()) == ["another checksum", "another length", "no vector", "not finite"]


def test_an_encoder_that_fails_adds_nothing(spark, texts, tmp_path):
    short = lambda rows: rows.select("content_key", F.array(F.lit(1.0)).alias("vector"))
    with pytest.raises(Exception, match="another length"):
        cache.encode_through(texts, f"{tmp_path}/c", "f", 2, short)
    assert cache.read_entries(spark, f"{tmp_path}/c").count() == 0


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    samples = spark.range(5000).select(
        F.concat(F.lit("s"), "id").alias("sample_id"), (F.col("id") % 50).cast("string").alias("rtl_key"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("gone"), "id")).when(F.col("id") % 3 == 1, (F.col("id") % 7).cast("string")).alias("asm_key"),
        F.repeat(F.sha2(F.col("id").cast("string").cast("binary"), 512), 20).alias("body"),
    )
    catalogue = store.write_keyed(samples.unionByName(samples.limit(0)), f"{path}/samples", "sample_id", files=8)
    store.write_keyed(spark.range(50).select(F.col("id").cast("string").alias("graph"), (F.col("id") * 2).alias("n")), f"{path}/graphs", "graph", files=3)
    assert catalogue.count() == 8 and catalogue.agg(F.sum("n")).first()[0] == 5000
    return path


def test_a_sample_and_its_graphs_are_read_from_one_place(spark, stored):
    row, graphs = store.read_sample(spark, f"{stored}/samples", f"{stored}/graphs", "s16")
    assert row.sample_id == "s16" and graphs["rtl_key"].n == 32 and graphs["asm_key"].n == 4
    row, graphs = store.read_sample(spark, f"{stored}/samples", f"{stored}/graphs", "s3")
    assert graphs["asm_key"] is None and graphs["rtl_key"].graph == "3"
    assert store.read_sample(spark, f"{stored}/samples", f"{stored}/graphs", "s5")[1]["asm_key"] is None
    with pytest.raises(store.NotStored):
        store.read_sample(spark, f"{stored}/samples", f"{stored}/graphs", "s5000")
    found = store.read_keyed(spark, f"{stored}/samples", "sample_id", "s77")
    assert len(found.inputFiles()) == 1 and found.count() == 1
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(place_), IsNotNull(sample_id), EqualTo(place_," in plan


def test_files_hold_ranges_and_filters(stored):
    ends = []
    for f in glob.glob(f"{stored}/samples/rows/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = [meta.row_group(0).column(k).path_in_schema for k in range(meta.num_columns)].index("place_")
        groups = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        ends.append((groups[0].min, groups[-1].max))
    ends.sort()
    assert len(ends) == 8 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_many_keys(spark, stored):
    wanted = spark.createDataFrame([("s1",), ("s1",), ("s4999",), ("none",), (None,)], "sample_id string")
    assert sorted(r.sample_id for r in store.read_many(spark, f"{stored}/samples", "sample_id", wanted).collect()) == ["s1", "s4999"]
    assert store.read_many(spark, f"{stored}/samples", "sample_id", wanted.where("false")).count() == 0
