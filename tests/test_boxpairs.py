"""Pairs of boxes in tiles against the same pairs row by row."""

import math

import pytest
from pyspark.sql import functions as F

from covlattice.operators import boxpairs, geometry, losses, metrics, pairs, tilepairs

TARGETS = boxpairs.Targets(sized=lambda a: a % 7 != 0, asked=lambda b: b % 5 != 0, apart=lambda a, b: (a + b) % 3 == 0)


@pytest.fixture(scope="module")
def boxes(spark):
    made = []
    for n in range(90):
        for k, t in enumerate(("line", "toggle")):
            lo = [((n * 37 + k * 11 + d * 5) % 50) / 100 for d in range(2)]
            hi = [x + ((n * 13 + d * 7 + k) % 40 + 5) / 100 for d, x in enumerate(lo)]
            lo, hi = (None, None) if n == 17 else (lo, hi)
            made.append((n % 2, n, t, lo, hi, ((n * 29 + k) % 31) / 31))
    return spark.createDataFrame(made, "module int, sample long, ctype string, lo array<double>, hi array<double>, truth double").localCheckpoint()


@pytest.fixture(scope="module", autouse=True)
def small_tiles():
    tilepairs.tiled.__defaults__, kept = (1, 16), tilepairs.tiled.__defaults__
    yield
    tilepairs.tiled.__defaults__ = kept


def joined(boxes, temperature=None):
    a, b = (boxes.select("module", "ctype", *[F.col(c).alias(f"{c}_{e}") for c in ("sample", "lo", "hi", "truth")]) for e in "ab")
    met = a.join(b, ["module", "ctype"]).where("sample_a < sample_b")
    g = geometry.box_geometry(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"), temperature)
    jaccard = F.when((F.col("sample_a") + F.col("sample_b")) % 3 == 0, 0.0).otherwise(F.abs(F.col("truth_a") - F.col("truth_b")))
    return met.withColumn("g", g).select(
        "*", "g.*", F.col("truth_a").alias("density_a"), F.col("truth_b").alias("density_b"), (F.col("sample_a") % 7 != 0).alias("size_mask"),
        jaccard.alias("jaccard"), (F.col("sample_b") % 5 != 0).alias("iou_mask"),
    )


@pytest.mark.parametrize("temperature", [None, 0.05])
def test_rows_of_all_pairs(spark, boxes, temperature):
    names = ["intersection", "iou", "log_iou", "meet"]
    key = ["module", "sample_a", "sample_b", "ctype"]
    made = {tuple(r[:4]): r[4:] for r in boxpairs.pair_rows(boxes, names, TARGETS, temperature).collect()}
    want = {tuple(r[:4]): r[4:] for r in joined(boxes, temperature).select(*key, *names).collect()}
    assert len(made) == 2 * 2 * 45 * 44 // 2 and made.keys() == want.keys()
    for k, row in want.items():
        for x, y in zip(made[k], row):
            assert (x is None and y is None) or x == pytest.approx(y, abs=2e-6)


def test_losses_and_metrics(boxes):
    rows = joined(boxes)
    assert tuple(boxpairs.iou_calibration(boxes, TARGETS).first()) == pytest.approx(tuple(losses.iou_calibration(rows).first()))
    batch = F.concat_ws("|", "module", "sample_a", F.floor(F.col("sample_b") / 16).cast("string"))
    ranked = rows.select(batch.alias("batch"), F.col("sample_b").alias("item"), "ctype", "iou", F.round("jaccard", 6).alias("jaccard"), "iou_mask")
    assert tuple(boxpairs.iou_rank_loss(boxes, TARGETS).first()) == pytest.approx(tuple(losses.iou_rank_loss(ranked).first()))
    whole = boxes.where("sample <> 17")
    assert tuple(boxpairs.geometry_metrics(whole, TARGETS).first()) == pytest.approx(tuple(metrics.geometry_metrics(joined(whole)).first()))


def test_rank_correlation(boxes):
    rows = joined(boxes).where("iou_mask").select(F.lit("iou").alias("ctype"), F.round("iou", 6).alias("x"), F.round("jaccard", 6).alias("y"))
    want = metrics.spearman(rows, "x", "y").first()
    got = boxpairs.rank_correlation(boxes, TARGETS).first()
    assert got.n == want.n and got.spearman == pytest.approx(want.spearman)


def test_volume_loss_counts_an_end_for_each_of_its_pairs(boxes):
    volumes = boxes.where("sample <> 17").withColumn("log_volume", geometry.log_product(geometry.widths(F.col("lo"), F.col("hi"))))
    both = joined(boxes.where("sample <> 17"))
    ends = [both.select("ctype", "size_mask", F.col(f"log_volume_{e}").alias("log_volume"), F.col(f"density_{e}").alias("density"), (F.col(f"sample_{e}") % 3 + 1).alias("weight")) for e in "ab"]
    want = losses.volume_loss(ends[0].unionByName(ends[1]), dims=2).first()
    samples = volumes.groupBy("module", "sample").agg(F.collect_list(F.struct("ctype", "log_volume", F.col("truth").alias("density"))).alias("t"))
    met = pairs.end_counts(samples, F.col("sample") % 7 != 0).where("ends > 0")
    rows = met.select((F.col("sample") % 3 + 1).alias("weight"), "ends", F.explode("t").alias("t")).select("t.*", "weight", "ends", F.lit(True).alias("size_mask"))
    assert tuple(losses.volume_loss(rows, dims=2, times="ends").first()) == pytest.approx(tuple(want))
    assert math.isfinite(want.loss)
