import numpy as np
import pytest
from pyspark.sql import functions as F

from covlattice.functions.vocab import NODE_TYPES
from covlattice.operators import encoder, graph


def test_memory_scales_ports_and_pairs_take_a_given_function(spark):
    rows = [("g", n, kind, port, m, 0.5) for n in ("mem", "add") for kind, port, m in ((0, 0, 2.0), (6, 1, 3.0), (4, 1, 10.0))]
    messages = spark.createDataFrame(rows, "graph string, dst string, edge_type int, target_port int, m double, attention double")
    kinds = [("g", "mem", NODE_TYPES.index("MEMORY")), ("g", "add", NODE_TYPES.index("ARITHMETIC")), ("g", "idle", NODE_TYPES.index("SHIFT"))]
    nodes = spark.createDataFrame(kinds, "graph string, node string, node_type int")
    scale = spark.createDataFrame([(0, 0.5), (1, 4.0)], "code int, scale double")
    layer = encoder.Dense(np.array([[2.0, 3.0, 1.0]]), np.array([1.0]), "relu")

    def pair(met):
        vector = F.array("port_a", "port_b", F.col("node_type").cast("double"))
        return encoder.dense(met.withColumn("pair", vector), "pair", [layer]).withColumn("pair", F.get("pair", F.lit(0)))

    out = {r.node: r.out for r in graph.routed_aggregate(messages, nodes, scale=scale, pair=pair).collect()}
    assert out["mem"] == pytest.approx(2.0 * 0.5 + 3.0 * 4.0)
    assert out["add"] == pytest.approx(2 * 2.0 + 3 * 13.0 + NODE_TYPES.index("ARITHMETIC") + 1)
    assert out["idle"] == pytest.approx(NODE_TYPES.index("SHIFT") + 1)
