import os
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from covlattice.llm import common, sharding


def test_report(docs, cases):
    got = sharding.shard_report(docs).collect()
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: zlib.crc32((t or "").encode())
    by_row = lambda rows: sorted(rows, key=str)
    assert by_row((r.doc_id, r["size"], r.text_crc32) for r in got) == by_row((i, size(t), crc(t)) for i, t in cases)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("texts", ["different", "equal"])
def test_shards_are_of_equal_bytes_even_of_one_hot_text(spark, texts):
    text = F.lit("same text for all") if texts == "equal" else F.repeat(F.concat(F.lit("t"), F.col("id")), (F.col("id") % 37).cast("int"))
    rows = spark.range(6000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), text.alias("text"))
    made = sharding.assign_shards(rows, shards=8).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    mean = sum(r.s for r in made) / 8
    assert len(made) == 8 and all(abs(r.s - mean) < 0.02 * mean and r.m == r.n - 1 for r in made)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_equal_texts_share_a_shard(spark, scale):
    """Groups of equal texts lie in one shard unless they are large; shards differ by a group or a document at most."""
    folder = f"/root/testdata/{scale}"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = sharding.assign_shards(docs).join(docs.select("doc_id", "text"), "doc_id")
    total = made.agg(F.sum("size")).first()[0]
    groups = made.groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.count_distinct("shard").alias("shards"), F.sum("size").alias("s"), F.max("size").alias("one")).collect()
    large = sharding.GROUP_SHARE * total / 40
    assert any(g.s > g.one for g in groups) and all(g.shards == 1 for g in groups if g.s <= large)
    largest = max(max(g.one for g in groups), large)
    for r in made.groupBy("shard").agg(F.sum("size").alias("s")).collect():
        assert abs(r.s - total / 40) <= largest + 2 * sharding.TOLERANCE * total / 40


def test_cells_number_without_gaps(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    made = sharding.assign_shards(rows, shards=4, cell_rows=50)
    by = made.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert len(by) == 4 and all((r.d, r.a, r.b) == (r.n, 0, r.n - 1) for r in by)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, sharding.assign_shards(rows, shards=4, cell_rows=50).collect())) == sorted(map(tuple, made.collect()))


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    assert sharding.write_shards(docs.drop("shard"), str(tmp_path / "s"), shards=5) == "shard"
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count()
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    column = sharding.write_shards(docs.withColumn("shard", F.lit("own")), str(tmp_path / "t"), shards=5)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert column != "shard" and {c for c in back.columns} == {*docs.columns, "shard", column}
    assert back.drop(column).exceptAll(docs.withColumn("shard", F.lit("own")).select(*[c for c in back.columns if c != column])).count() == 0


def test_empty_table(empty):
    assert sharding.shard_report(empty).count() == 0
