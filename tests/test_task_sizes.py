"""A task's share does not grow with the table: more rows are more tasks."""

import pytest
from pyspark.sql import functions as F

from covlattice import session
from covlattice.operators import accumulate, gated, graph, order, splits
from tests.test_gated import weights


@pytest.fixture(autouse=True)
def as_large_tables_are_joined(spark):
    """By a shuffle: the tables of these tests would be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def ring(spark, n):
    nodes = spark.range(n).select(F.lit(0).alias("graph"), F.col("id").alias("node"), F.array(F.lit(1.0)).alias("x"))
    edges = spark.range(n).select(F.lit(0).alias("graph"), F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    return edges, nodes


def biggest_part(rows):
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    edges, nodes = ring(spark, 1000)
    kept = graph.valid_edges(edges, nodes)
    assert kept.count() == 1000 and biggest_part(kept) < 100
    normed = graph.gcn_norm(kept, nodes)
    assert normed.count() == 2000 and biggest_part(normed) < 200
    assert {round(r.x[0], 9) for r in graph.gcn_propagate(edges, nodes).collect()} == {1.0}


@pytest.mark.parametrize("by", [None, ["m"]])
def test_ranges_grow_in_number_with_the_rows(spark, monkeypatch, by):
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    rows = spark.range(1000).select((F.col("id") % 2).alias("m"), F.col("id").alias("k"), F.lit(1).cast("long").alias("one"))
    placed = order.running_total(rows, ["k"], "one", "before", by)
    assert biggest_part(placed) < 200
    assert {(r.k, r.before) for r in placed.collect()} == {(k, k // 2 if by else k) for k in range(1000)}


def test_a_module_is_no_task(spark, monkeypatch):
    """All stimuli of one module: their totals meet its size without a shuffle by module."""
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    seen = []
    join = splits.join_counted
    monkeypatch.setattr(splits, "join_counted", lambda *a: seen.append(join(*a)) or seen[-1])
    rows = spark.range(1000).select(F.col("id").alias("test_id"), F.lit(0).alias("module"))
    assert splits.sequential_split(rows).where("is_val").count() == 100
    assert seen and all(biggest_part(s) < 200 for s in seen)


class Unasked:
    def __call__(self, x):
        raise AssertionError("nobody asked for these edges")


def test_edges_after_the_last_layer_are_made_for_those_who_ask(spark):
    w = weights(0)
    w = gated.GatedWeights(**{**w.__dict__, "edge": [Unasked()]})
    nodes = spark.createDataFrame([("g", k, k % 3, [float(k)] * 4) for k in range(6)], "graph string, node long, node_type int, x array<double>")
    edges = spark.createDataFrame([("g", k, (k + 1) % 6, 0, 0, [0.5] * 4) for k in range(6)], "graph string, src long, dst long, edge_type int, target_port int, e array<double>")
    got, after = gated.gated_layers(nodes, edges, [w])
    assert got.count() == 6
    with pytest.raises(Exception, match="nobody asked"):
        after.collect()


def test_accumulators_of_many_and_of_null_keys(spark, monkeypatch):
    """More keys than a task holds, keys of two columns, nulls among them."""
    monkeypatch.setattr(accumulate, "HELD", 16)
    rows = spark.range(5000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 7).alias("a"), (F.col("id") % 30).cast("string").alias("b"), F.col("id").cast("double").alias("v"))
    import numpy as np

    layout = accumulate.Layout(1, 1, 0, 0)
    made = accumulate.accumulate(rows, ["a", "b"], layout, lambda batch: np.stack([batch.column("v").to_numpy()] * 2, 1))
    got = {(r.a, r.b): tuple(r.acc) for r in made.collect()}
    want = {}
    for i in range(5000):
        s, m = want.get((i % 7 or None, str(i % 30)), (0, 0))
        want[i % 7 or None, str(i % 30)] = s + i, max(m, i)
    assert got == want and made.count() == 210
