import numpy as np
import pytest
from pyspark.sql import functions as F

from covlattice.operators import encoder
from covlattice.operators.encoder import Dense


def norm(x):
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def test_layers_are_those_of_numpy(spark):
    r = np.random.default_rng(1)
    x, e = r.normal(size=(4, 3)), r.normal(size=(3, 2))
    ends = [(0, 1), (2, 1), (1, 3)]
    message = [Dense(r.normal(size=(5, 5)), r.normal(size=5), "gelu"), Dense(r.normal(size=(3, 5)), r.normal(size=3))]
    update = [Dense(r.normal(size=(3, 6)), r.normal(size=3), "relu")]
    nodes = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "graph string, node int, x array<double>")
    edges = spark.createDataFrame([("g", s, t, v.tolist()) for (s, t), v in zip(ends, e)], "graph string, src int, dst int, e array<double>")

    summed = np.zeros((4, 3))
    for (s, t), v in zip(ends, e):
        m = np.r_[x[s], v]
        for layer in message:
            m = layer(m)
        summed[t] += m
    want = norm(x + update[0](np.concatenate([x, summed], axis=1)))
    got = {n.node: n.x for n in encoder.message_layer(nodes, edges, message, update).collect()}
    assert np.allclose([got[i] for i in range(4)], want)
    pooled = encoder.encode(nodes, edges, [(message, update)])
    assert np.allclose(pooled.first().x, want.mean(axis=0))
    head = encoder.coverage_head(pooled, [Dense(np.ones((1, 3)), np.zeros(1), "sigmoid")]).first()
    assert np.allclose(head.y, 1 / (1 + np.exp(-want.mean(axis=0).sum())))
    new = encoder.edge_update(edges, nodes, [Dense(np.ones((1, 8)), np.zeros(1))]).where("src = 0").first()
    assert np.allclose(new.e, x[0].sum() + x[1].sum() + e[0].sum())


def test_features(spark):
    cells = spark.createDataFrame([(0, [1.0, 2.0, 4.0])], "code int, vector array<double>")
    nodes = spark.createDataFrame([("g", "a", 0, 7)], "graph string, node string, cell int, width int")
    got = encoder.node_features(nodes, cells, [1.0, 0.0, 0.0]).first().x
    assert np.allclose(got, norm(np.array([1.0 + 3, 2, 4])))
    edges = spark.createDataFrame([("g", 0, 1, 9, 1)], "graph string, edge_type int, source_port int, target_port int, width int")
    made = encoder.edge_features(edges, cells, cells.withColumn("code", F.lit(1)), [0.0, 0.0, 1.0]).first().e
    assert made == [1.0, 2.0, 5.0, 1.0, 2.0, 4.0, 0.0, 0.0, 0.0]


def test_text_vectors_and_pooling(spark):
    rows = encoder.hashed_text(spark.createDataFrame([("a b a",), ("",), (None,)], "text string"), 16).collect()
    assert sum(v * v for v in rows[0].vector) == pytest.approx(1.0) and set(rows[1].vector) == set(rows[2].vector) == {0.0}
    tokens = spark.createDataFrame([(1, 0, True, [1.0, 0.0]), (1, 1, True, [3.0, 2.0]), (1, 2, False, [9.0, 9.0])], "text_id int, position int, attended boolean, x array<double>")
    assert encoder.token_pool(tokens).first().x == [2.0, 1.0] and encoder.token_pool(tokens, "cls").first().x == [1.0, 0.0]
    with pytest.raises(ValueError):
        encoder.token_pool(tokens, "max")
    with pytest.raises(ValueError):
        Dense(np.ones((1, 2)), np.zeros(2))
