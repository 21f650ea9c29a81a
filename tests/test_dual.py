import numpy as np
import pytest

from covlattice.operators import dual, fusion, graph
from covlattice.operators.dual import Attention, DualLayer, FlowWeights, FusionWeights
from covlattice.operators.encoder import Dense

from .test_gated import D, node_by_node, norm, run, softmax, weights


def layer(r, n, m, act="none"):
    return Dense(r.normal(0, 0.5, (m, n)), r.normal(0, 0.5, m), act)


def mlp(r, n, m):
    return [layer(r, n, 2 * D, "gelu"), layer(r, 2 * D, m)]


def fusion_weights(seed, heads=2, latents=3):
    r = np.random.default_rng(seed)
    attention = lambda: Attention(layer(r, D, D), layer(r, D, D), layer(r, D, D), layer(r, D, D), heads)
    return FusionWeights(r.normal(0, 1, (latents, D)), attention(), attention(), layer(r, 2 * D, D, "sigmoid"), mlp(r, D, D))


def attend(a, q, kv, value):
    """Multi-head attention of one query over rows."""
    q, k, v = a.query(q[None])[0].reshape(a.heads, -1), a.key(kv).reshape(len(kv), a.heads, -1), a.value(value).reshape(len(kv), a.heads, -1)
    return a.out(np.concatenate([softmax(k[:, h] @ q[h] / np.sqrt(q.shape[1])) @ v[:, h] for h in range(a.heads)])[None])[0]


def fuse(x, source, w):
    z = np.zeros(w.latents.shape)
    if len(source):
        s = np.array([norm(v) for v in source])
        z = np.array([attend(w.pool, q, s, s) for q in w.latents])
    context = norm(attend(w.read, norm(x), z, z))
    return x + w.gate(np.r_[x, context][None])[0] * run(w.mlp, context)


def flow(x, edges, w):
    new = {n: norm(v + sum((run(w.message, np.r_[x[s], e]) for s, d, e in edges if d == n), np.zeros(D))) for n, v in x.items()}
    return new, [(s, d, norm(e + run(w.edge, np.r_[new[d], new[s], e]))) for s, d, e in edges]


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(9)
    types = {("a", n): n % 12 for n in range(24)} | {("b", n): 3 for n in range(3)}
    x = {k: r.normal(size=D) for k in types}
    edges = [("a", int(r.integers(24)), int(r.integers(24)), int(r.choice([0, 1, 2, 4, 5, 6])), int(r.integers(3)), r.normal(size=D)) for _ in range(60)] + [("b", 0, 1, 3, 0, r.normal(size=D))]
    y = {("a", n): r.normal(size=D) for n in range(9)} | {("only", 0): r.normal(size=D)}  # b has no second graph
    flows = [("a", int(r.integers(9)), int(r.integers(9)), r.normal(size=D)) for _ in range(20)]
    frames = (
        spark.createDataFrame([(g, n, types[g, n], v.tolist()) for (g, n), v in x.items()], "graph string, node int, node_type int, x array<double>").repartition(3),
        spark.createDataFrame([(*e[:5], e[5].tolist()) for e in edges], "graph string, src int, dst int, edge_type int, target_port int, e array<double>").repartition(4),
        spark.createDataFrame([(g, n, v.tolist()) for (g, n), v in y.items()], "graph string, node int, x array<double>").repartition(2),
        spark.createDataFrame([(*e[:3], e[3].tolist()) for e in flows], "graph string, src int, dst int, e array<double>").repartition(2),
    )
    return types, x, edges, y, flows, frames


@pytest.mark.parametrize("fusing, few", [(True, 10_000), (True, 0), (False, 10_000)])
def test_supersteps_are_those_of_node_by_node(sample, monkeypatch, fusing, few):
    monkeypatch.setattr(fusion, "BROADCAST_GRAPHS", few)
    types, x, edges, y, flows, frames = sample
    r = np.random.default_rng(4)
    layers = [
        DualLayer(weights(k), FlowWeights(mlp(r, 2 * D, D), mlp(r, 3 * D, D)), *((fusion_weights(k), fusion_weights(k + 5)) if fusing else ()))
        for k in range(2)
    ]
    made, made_flow = dual.dual_encode(*frames, layers)
    for w in layers:
        x, moved = node_by_node(x, types, [((g, s), (g, d), k, p, e) for g, s, d, k, p, e in edges], w.gated)
        edges = [(s[0], s[1], d[1], k, p, e) for s, d, k, p, e in moved]
        y, moved = flow(y, [((g, s), (g, d), e) for g, s, d, e in flows], w.flow)
        flows = [(s[0], s[1], d[1], e) for s, d, e in moved]
        if fusing:
            before, flow_before = x, y
            x = {k: fuse(v, [u for (g, _), u in flow_before.items() if g == k[0]], w.into_gated) for k, v in before.items()}
            y = {k: fuse(v, [u for (g, _), u in before.items() if g == k[0]], w.into_flow) for k, v in flow_before.items()}
    got = {(n.graph, n.node): n.x for n in made.collect()}
    assert got.keys() == x.keys() and all(np.allclose(got[k], x[k]) for k in x)
    got = {(n.graph, n.node): n.x for n in made_flow.collect()}
    assert got.keys() == y.keys() and all(np.allclose(got[k], y[k]) for k in y)
    both = dual.graph_vectors(made, made_flow).collect()
    assert [b.graph for b in both] == ["a"]
    want = np.concatenate([np.mean([v for (g, _), v in m.items() if g == "a"], axis=0) for m in (x, y)])
    assert np.allclose(both[0].x, want)


def test_convolution_with_weights(spark):
    r = np.random.default_rng(2)
    x, ends = r.normal(size=(6, 3)), [(0, 1), (2, 1), (1, 3), (4, 1), (4, 1)]
    w = Dense(r.normal(size=(3, 3)), r.normal(size=3))
    a = np.eye(6)
    for s, d in ends:
        a[d, s] += 1
    deg = a.sum(1)
    a = a / np.sqrt(deg[:, None] * deg[None, :])
    want = [norm(v) for v in x + Dense(np.eye(3), w.bias, "gelu")(a @ x @ w.weight.T)]
    nodes = spark.createDataFrame([("g", n, "kept", v.tolist()) for n, v in enumerate(x)], "graph string, node int, name string, x array<double>")
    edges = spark.createDataFrame([("g", s, d) for s, d in ends], "graph string, src int, dst int")
    made = dual.gcn_layer(nodes, graph.gcn_norm(edges, nodes), w).collect()
    assert all(np.allclose(n.x, want[n.node]) and n.name == "kept" for n in made) and len(made) == 6


def test_adapter_is_a_residual(spark):
    r = np.random.default_rng(3)
    layers = [layer(r, 3, 3, "gelu"), layer(r, 3, 3)]
    x = r.normal(size=3)
    made = dual.adapted(spark.createDataFrame([(1, x.tolist())], "id int, x array<double>"), "x", layers).first()
    assert np.allclose(made.x, x + run(layers, norm(x)))
    still = dual.adapted(spark.createDataFrame([(1, x.tolist())], "id int, x array<double>"), "x", [layers[0], Dense(np.zeros((3, 3)), np.zeros(3))]).first()
    assert np.allclose(still.x, x)
