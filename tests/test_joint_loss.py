"""The joint loss of all pairs: every part of it, smooth boxes, both ends."""

import os

import pytest
from pyspark.sql import functions as F

from covlattice.operators import boxpairs, losses, tilepairs
from covlattice.plans.queries import QUERIES
from covlattice.plans.sql import ORACLES
from tests.test_boxpairs import TARGETS, joined

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def small_tiles():
    tilepairs.tiled.__defaults__, kept = (1, 16), tilepairs.tiled.__defaults__
    yield
    tilepairs.tiled.__defaults__ = kept


@pytest.fixture(scope="module")
def boxes(spark):
    made = []
    for n in range(70):
        for k, t in enumerate(("line", "toggle")):
            lo = [((n * 37 + k * 11 + d * 5) % 50) / 100 for d in range(2)]
            hi = [x + ((n * 13 + d * 7 + k) % 40 + 5) / 100 for d, x in enumerate(lo)]
            lo, hi = (None, None) if n == 17 else (lo, hi)
            made.append((n % 2, n, t, lo, hi, ((n * 29 + k) % 31) / 31))
    return spark.createDataFrame(made, "module int, sample long, ctype string, lo array<double>, hi array<double>, truth double").localCheckpoint()


@pytest.mark.parametrize("temperature", [None, 0.05, 0.002])
def test_iou_losses_are_those_of_the_rows(boxes, temperature):
    rows = joined(boxes, temperature)
    batch = F.concat_ws("|", "module", "sample_a", F.floor(F.col("sample_b") / 16).cast("string"))
    ranked = rows.select(batch.alias("batch"), F.col("sample_b").alias("item"), "ctype", "iou", F.round("jaccard", 6).alias("jaccard"), "iou_mask")
    got = boxpairs.iou_losses(boxes, TARGETS, temperature=temperature).first()
    assert got.calibration == pytest.approx(losses.iou_calibration(rows, log_iou=None if temperature is None else "log_iou").first().loss)
    assert got["rank"] == pytest.approx(losses.iou_rank_loss(ranked).first().loss)


def test_graph_loss_counts_a_row_for_its_pairs(spark):
    rows = spark.createDataFrame([("line", 0.2, 0.1, 1.0, 3), ("line", 0.6, 0.5, 2.0, 0), ("fsm", 0.9, 0.2, 2.0, 1)], "ctype string, pred double, target double, weight double, n long")
    copies = rows.where("n > 0").withColumn("one", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    assert tuple(losses.weighted_graph_loss(rows, times="n").first()) == pytest.approx(tuple(losses.weighted_graph_loss(copies).first()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_joint_loss_has_all_parts(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    got = {r.epoch: r.loss for r in QUERIES["joint_loss"](spark, DATA).collect()}
    assert got == pytest.approx(dict(con.execute(ORACLES["joint_loss"]).fetchall()), abs=2e-6)
    volume = QUERIES["volume_loss"](spark, DATA).first().loss
    assert got[2] - got[1] == pytest.approx(0.25 * volume / 4, abs=2e-6)  # the volume part is the measured one
    assert got[4] == got[5]
