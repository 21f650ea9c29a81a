import math

import pytest
from pyspark.sql import functions as F

from covlattice.functions import scalar
from covlattice.operators import geometry, inference, losses, metrics

BOX = "lo_a array<double>, hi_a array<double>, lo_b array<double>, hi_b array<double>"


def box(spark, rows, temperature=None):
    g = geometry.box_geometry(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"), temperature)
    return [r.g for r in spark.createDataFrame(rows, BOX).select(g.alias("g")).collect()]


def test_iou_of_half_boxes(spark):
    rest = [0.0] * 9, [1.0] * 9
    (g,) = box(spark, [([0.0] + rest[0], [0.5] + rest[1], [0.25] + rest[0], [0.75] + rest[1])])
    assert (g.volume_a, g.volume_b, g.intersection) == pytest.approx((0.5, 0.5, 0.25))
    assert g.iou == pytest.approx(1 / 3) and g.meet


def test_boxes_apart(spark):
    rows = [([0.0, 0.0], [0.2, 1.0], [0.5, 0.0], [0.9, 1.0])]
    (hard,), (soft,) = box(spark, rows), box(spark, rows, 0.05)
    assert (hard.iou, hard.intersection, hard.log_iou, hard.meet) == (0.0, 0.0, None, False)
    assert 0 < soft.iou < 0.01 and soft.log_iou < 0
    with pytest.raises(ValueError):
        geometry.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 0.0)


def test_head_stays_in_the_unit_cube(spark):
    rows = [([-40.0, 0.0, 40.0], [40.0, -40.0, 0.0])]
    b = spark.createDataFrame(rows, "c array<double>, r array<double>").select(geometry.box_from_logits(F.col("c"), F.col("r")).alias("b")).first().b
    assert all(-1e-9 <= x < y <= 1 + 1e-9 for x, y in zip(b.lo, b.hi))
    assert b.hi[1] - b.lo[1] == pytest.approx(1e-3)


def test_volume_loss(spark):
    cols = "ctype string, log_volume double, density double, size_mask boolean, weight double"
    one = spark.createDataFrame([("line", 0.0, math.exp(-0.5), True, 1.0), ("fsm", 0.0, 0.5, False, 1.0)], cols)
    assert losses.volume_loss(one, dims=5).first().loss == pytest.approx(0.125)
    weighted = spark.createDataFrame([("line", 0.0, math.exp(-0.5), True, 3.0), ("line", 0.0, math.exp(-0.5), True, 1.0)], cols)
    assert losses.volume_loss(weighted, dims=5).first().loss == pytest.approx(0.25)
    with pytest.raises(Exception, match="negative weight"):
        losses.volume_loss(spark.createDataFrame([("line", 0.0, 0.5, True, -1.0)], cols), dims=5).collect()


def test_iou_calibration(spark):
    cols = "ctype string, iou double, jaccard double, iou_mask boolean"
    rows = [("line", 0.25, 0.5, True), ("line", 0.3, 0.0, True), ("fsm", 0.9, 0.1, False)]
    d = math.log(0.25) - math.log(0.5)
    assert losses.iou_calibration(spark.createDataFrame(rows, cols)).first().loss == pytest.approx((0.5 * d * d + 0.09) / 2)
    assert losses.iou_calibration(spark.createDataFrame([], cols)).first().loss == 0.0


def test_rank_loss(spark):
    cols = "batch int, item int, ctype string, iou double, jaccard double, iou_mask boolean"
    rows = [(0, 0, "line", 0.4, 0.2, True), (0, 1, "line", 0.4, 0.8, True), (0, 2, "line", 0.4, 0.81, False), (1, 0, "line", 0.1, 0.5, True)]
    assert tuple(losses.iou_rank_loss(spark.createDataFrame(rows, cols)).first()) == pytest.approx((0.05, 1, 1))
    with pytest.raises(ValueError):
        losses.RankConfig(margin=-1)


def test_graph_loss_divides_by_rows(spark):
    cols = "ctype string, pred double, target double, weight double"
    rows = [("branch", 1.0, 0.0, 1.0), ("branch", 0.0, 0.0, 3.0), ("branch", 5.0, None, 1.0), ("branch", 2.0, float("nan"), 1.0)]
    got = losses.weighted_graph_loss(spark.createDataFrame(rows, cols), relative_weight=0.0).first()
    assert (got.loss, got.n_targets) == (0.25, 2)
    rel = spark.createDataFrame([("branch", 0.2, 0.1, 1.0), ("branch", 0.6, 0.5, 1.0)], cols)
    want = (0.005 + 0.1 * 0.5 + 0.005 + 0.1 * 0.5 * 0.04) / 2
    assert losses.weighted_graph_loss(rel).first().loss == pytest.approx(want)


def test_regression_metrics(spark):
    cols = "ctype string, pred double, target double"
    rows = [("line", float(p), float(t)) for p, t in zip(range(4), (0, 0, 2, 3))]
    rows += [("flat", 1.0, 2.0), ("flat", 2.0, 2.0), ("perfect", 2.0, 2.0), ("perfect", 2.0, 2.0), ("line", 9.0, None), ("nan", float("nan"), 1.0)]
    by = {r.ctype: r for r in metrics.regression_metrics(spark.createDataFrame(rows, cols)).collect()}
    assert (by["line"].r2, by["line"].pearson_r) == pytest.approx((0.8518519, 0.9467293))
    assert (by["line"].n, by["line"].median_ae, by["line"].mape) == (4, 0.0, 0.0)
    assert (by["flat"].r2, by["perfect"].r2) == (0.0, 1.0)
    assert by["nan"].mse is None


def test_spearman(spark):
    cols = "ctype string, x double, y double"
    rows = [("a", x, y) for x, y in zip((0.1, 0.2, 0.3, 0.4), (0.1, 0.2, 0.4, 0.3))] + [("b", 1.0, 2.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)]
    by = {r.ctype: r.spearman for r in metrics.spearman(spark.createDataFrame(rows, cols), "x", "y").collect()}
    assert by == {"a": pytest.approx(0.8), "b": 0.0, "c": 0.0}


def test_schedules(spark):
    row = spark.range(1).select(
        *[scalar.lr_factor(F.lit(s), 100, 50, k).alias(f"{k}{s}") for k in ("cosine", "linear", "constant") for s in (5, 10, 55, 100)],
        scalar.volume_warmup(F.lit(2), 4).alias("w"), scalar.gelu(F.lit(1.0)).alias("g"), scalar.softplus(F.lit(800.0)).alias("p"),
        scalar.drop_path_rate(F.lit(3), 0.1, 4).alias("d"),
    ).first()
    assert (row.cosine5, row.cosine10, row.cosine55, row.linear55, row.constant100) == pytest.approx((0.5, 1.0, 0.5, 0.5, 1.0))
    assert (row.w, row.g, row.p, row.d) == pytest.approx((0.5, 0.841344746, 800.0, 0.1), abs=1e-6)


def test_prediction_records(spark):
    cols = "sample_id string, coverage map<string, double>, ctype string, lo array<double>, hi array<double>"
    good = spark.createDataFrame([("s", {"line": 0.5}, "line", [0.1] * 10, [0.6] * 10)], cols)
    row = inference.prediction_records(good).first()
    assert row.mean_volume == pytest.approx(0.5**10) and row.coverage_space["line"].min == [0.1] * 10
    for bad in [
        ("s", {"line": float("nan")}, "line", [0.1], [0.6]),
        ("s", {"line": 0.5}, "line", [0.7], [0.6]),
        ("s", {"line": 0.5}, "line", [0.1, 0.2], [0.6]),
        ("s", {"line": 0.5}, "line", [float("inf")], [0.6]),
    ]:
        with pytest.raises(Exception, match="finite"):
            inference.prediction_records(spark.createDataFrame([bad], cols)).collect()


def test_predictions_are_matched_by_key(spark, tmp_path):
    ids = spark.createDataFrame([("b",), ("a",)], "sample_id string")
    made = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sample_id string, mean_volume double")
    assert {r.sample_id: r.mean_volume for r in inference.match_predictions(ids, made).collect()} == {"a": 1.0, "b": 2.0}
    with pytest.raises(Exception, match="no prediction"):
        inference.match_predictions(ids, made.where("sample_id = 'a'")).collect()
    with pytest.raises(Exception, match="repeated"):
        inference.require_unique(ids.union(ids)).collect()
    inference.write_records(spark.createDataFrame([("é😀",)], "sample_id string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value.lower() == '{"sample_id":"\\u00e9\\ud83d\\ude00"}'
