import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from covlattice.functions.vocab import AGG_GROUPS, EDGE_TYPES, NODE_TYPES
from covlattice.operators import fusion, gated, graph, joins, metrics
from covlattice.operators.encoder import Dense, erf
from covlattice.operators.gated import GatedWeights

D = 4


def weights(seed):
    r = np.random.default_rng(seed)
    layer = lambda n, m, act="none": Dense(r.normal(0, 0.5, (m, n)), r.normal(0, 0.5, m), act)
    mlp = lambda n, m: [layer(n, 2 * D, "gelu"), layer(2 * D, m)]
    return GatedWeights(
        mlp(2 * D, D), mlp(2 * D, D), layer(2 * D, 1), [layer(D, D // 2, "gelu"), layer(D // 2, 2)], r.normal(0, 1, (10, 3)), layer(D, D, "sigmoid"),
        layer(D, D, "sigmoid"), r.normal(0, 1, (3, D)), mlp(3 * D, D), r.normal(1, 0.5, (8, D)), mlp(2 * D, D), mlp(2 * D, D),
    )


def norm(x):
    return (x - x.mean()) / math.sqrt(x.var() + 1e-5)


def run(layers, x):
    for layer in layers:
        x = layer(x[None])[0]
    return x


def softmax(x):
    return np.exp(x - x.max()) / np.exp(x - x.max()).sum()


def node_by_node(x, types, edges, w):
    """A layer, one node after the other: x by node, edges (src, dst, kind, port, e)."""
    new = {}
    for n, v in x.items():
        got = [(k, p, run(w.control if EDGE_TYPES[k] == "CONTROL" else w.data, np.r_[x[s], e]), w.attention(np.r_[x[s], e][None])[0, 0]) for s, d, k, p, e in edges if d == n]
        zero = np.zeros(D)
        by = {name: sum((m for k, _, m, _ in got if EDGE_TYPES[k] == name), zero) for name in EDGE_TYPES}
        a, b = (sum((m for _, p, m, _ in got if p == port), zero) for port in (0, 1))
        kind = NODE_TYPES[types[n]]
        if any(EDGE_TYPES[k] == "CONTROL" for k, *_ in got):
            g = softmax(run(w.gate, by["CONTROL"]))
            out = g[0] * by["DATA_TRUE"] + g[1] * by["DATA_FALSE"] + by["DATA"] + by["CLOCK"] + by["RESET"] + by["ENABLE"]
        elif kind == "SEQUENTIAL":
            r, e = w.reset(by["RESET"][None])[0], w.enable(by["ENABLE"][None])[0]
            out = r * by["RESET"] + (1 - r) * (e * by["DATA"] + (1 - e) * by["CLOCK"])
        elif kind == "MEMORY":
            out = sum((m * (w.port_scale[p] if p < 8 else 1) for k, p, m, _ in got if EDGE_TYPES[k] in ("DATA", "ENABLE")), zero)
        elif kind in ("ARITHMETIC", "COMPARE", "SHIFT"):
            out = run(w.pair, np.r_[a, b, w.pair_types[("ARITHMETIC", "COMPARE", "SHIFT").index(kind)]])
        else:
            mix = softmax(w.mix[AGG_GROUPS[types[n]]])
            if got:
                att = softmax(np.array([s for *_, s in got]))
                ms = np.array([m for _, _, m, _ in got])
                out = mix[0] * (att[:, None] * ms).sum(0) + mix[1] * ms.mean(0) + mix[2] * np.maximum(ms.max(0), 0)
            else:
                out = zero
        new[n] = norm(v + run(w.update, np.r_[v, out]))
    return new, [(s, d, k, p, norm(e + run(w.edge, np.r_[new[s], e]))) for s, d, k, p, e in edges]


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_are_those_of_node_by_node(spark, seed):
    r = np.random.default_rng(seed)
    types = {n: n % 12 for n in range(40)}
    x = {n: r.normal(size=D) for n in types}
    edges = [(int(r.integers(40)), int(r.integers(30) if r.random() < 0.5 else 7), int(r.choice(7, p=[0.3, 0.1, 0.1, 0.05, 0.15, 0.15, 0.15])), int(r.integers(10)), r.normal(size=D) * 3) for _ in range(300)]
    edges = [e for e in edges if EDGE_TYPES[e[2]] != "CONTROL" or e[1] in (7, 8, 9)]
    nodes = spark.createDataFrame([("g", n, types[n], v.tolist()) for n, v in x.items()], "graph string, node long, node_type int, x array<double>")
    rows = [("g", s, d, k, p, e.tolist()) for s, d, k, p, e in edges] + [("g", 999, 3, 0, 0, [1.0] * D)]  # no such source
    table = spark.createDataFrame(rows, "graph string, src long, dst long, edge_type int, target_port int, e array<double>").repartition(5)
    layers = [weights(seed), weights(seed + 10)]
    made, made_edges = gated.gated_layers(nodes, table, layers)
    for w in layers:
        x, edges = node_by_node(x, types, edges, w)
    got = {n.node: n.x for n in made.collect()}
    assert all(np.allclose(got[n], v) for n, v in x.items()) and len(got) == 40
    assert np.allclose(sorted(e.e for e in made_edges.collect()), sorted(e.tolist() for *_, e in edges))


def test_empty_graph(spark):
    nodes = spark.createDataFrame([], "graph string, node long, node_type int, x array<double>")
    edges = spark.createDataFrame([], "graph string, src long, dst long, edge_type int, target_port int, e array<double>")
    made, left = gated.gated_layers(nodes, edges, [weights(1)])
    assert made.count() == left.count() == 0


def test_erf():
    x = np.linspace(-8, 8, 4001)
    assert np.abs(erf(x) - np.array([math.erf(v) for v in x])).max() < 4e-15 and erf(np.zeros(0)).size == 0


@pytest.mark.parametrize("few", [10_000, 0])
def test_cross_attention(spark, monkeypatch, few):
    """Pooling and reading of a hot graph, a small one, one without nodes in the source and one of null vectors."""
    monkeypatch.setattr(fusion, "BROADCAST_GRAPHS", few)
    r = np.random.default_rng(3)
    source = {"hot": r.normal(size=(400, 3)) * 5, "small": r.normal(size=(2, 3))}
    target = {"hot": r.normal(size=(300, 3)), "small": r.normal(size=(3, 3)), "alone": r.normal(size=(2, 3)), "nulls": r.normal(size=(1, 3))}
    rows = [(g, v.tolist()) for g, m in source.items() for v in m] + [("nulls", None)]
    latents = [(5, [1.0, 0.0, 2.0]), (2, [0.0, -1.0, 1.0])]
    pooled = fusion.cross_pool(spark.createDataFrame(rows, "graph string, x array<double>").repartition(6), spark.createDataFrame(latents, "latent int, q array<double>"), 3)
    got = {(p.graph, p.latent): p.x for p in pooled.collect()}
    want = {(g, k): (softmax(m @ np.array(q) / math.sqrt(3))[:, None] * m).sum(0) for g, m in source.items() for k, q in latents}
    want |= {("nulls", k): np.zeros(3) for k, _ in latents}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    nodes = [(g, k, v.tolist()) for g, m in target.items() for k, v in enumerate(m)]
    read = fusion.cross_read(spark.createDataFrame(nodes, "graph string, node int, x array<double>").repartition(6), pooled, 0.25, 3)
    out = {(n.graph, n.node): n.x for n in read.collect()}
    assert len(out) == len(nodes)
    for g, k, v in nodes:
        z = np.array([want[g, n] for n in (2, 5)]) if (g, 2) in want else np.zeros((1, 3))
        assert np.allclose(out[g, k], np.array(v) + 0.25 * softmax(z @ np.array(v) / math.sqrt(3)) @ z)


@pytest.mark.parametrize("few", [100_000, 0])
def test_hot_targets_and_values(spark, monkeypatch, few):
    """A target of nine tenths of the edges, and a value of nine tenths of the rows, by broadcast of all and of the hot ones."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", few)
    r = np.random.default_rng(4)
    n = 5000
    dst = np.where(r.random(n) < 0.9, 0, r.integers(1, 200, n))
    score = r.normal(0, 200, n)
    edges = spark.createDataFrame([("g", k, int(d), float(s)) for k, (d, s) in enumerate(zip(dst, score))], "graph string, src int, dst int, score double")
    got = {e.src: e.attention for e in graph.attention_softmax(edges).collect()}
    for d in set(dst.tolist()):
        at = np.flatnonzero(dst == d)
        assert np.allclose([got[k] for k in at], softmax(score[at]), atol=1e-12)
    value = np.where(r.random(n) < 0.9, 0.0, r.integers(0, 50, n).astype(float))
    ranked = metrics.average_ranks(spark.createDataFrame([(k, float(v)) for k, v in enumerate(value)], "k int, v double"), "v", "rank")
    want = {v: (np.sum(value < v) + (np.sum(value == v) + 1) / 2) for v in set(value.tolist())}
    assert {x.k: x["rank"] for x in ranked.collect()} == {k: want[v] for k, v in enumerate(value.tolist())}


def test_no_task_reads_the_hot_key(spark, monkeypatch):
    """With nothing but hot keys sent by broadcast, the rows of the hot key stay where they are."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    rows = spark.range(0, 20_000, 1, 20).select(F.when(F.col("id") % 10 != 0, 0).otherwise(F.col("id")).alias("v"), "id")
    found = rows.groupBy("v").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = joins.join_counted(rows, found, ["v"], "n").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(p["count"] for p in parts) == 20_000 and max(p["count"] for p in parts) < 2_000
