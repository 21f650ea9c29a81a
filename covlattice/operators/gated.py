"""The control-gated layer over node and edge vectors, with given weights.

Edges carry the vector of their source; a task turns them into messages and
accumulates these by target (:mod:`covlattice.operators.accumulate`): a sum for
each edge type, for the ports 0 and 1 and for scaled memory messages, the
largest value from 0 up, and one softmax group of attention.  The accumulators
are merged once by (graph, target), so a target with a third of all edges is a
few rows for each task.  Nodes then route their sums by type.

Layers follow each other as supersteps: node and edge state are written between
them, and a layer shuffles the edges once to meet their sources and the
accumulators once to meet their targets.  The edges after the last layer are a
plan: who asks for the nodes only does not make them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covlattice.functions.vocab import AGG_GROUPS, EDGE_TYPES, NODE_TYPES
from covlattice.operators.accumulate import Layout, accumulate
from covlattice.operators.encoder import Dense
from covlattice.session import written_once

_DATA, _TRUE, _FALSE, _CONTROL, _CLOCK, _RESET, _ENABLE = range(len(EDGE_TYPES))


@dataclass(frozen=True)
class GatedWeights:
    """Weights of a layer over vectors of ``dims`` places.

    ``data`` and ``control`` make messages of [source, edge]; ``attention``
    scores the same; ``gate`` turns the control sum into two logits; ``mix`` has
    logits of sum, mean and maximum for each aggregation group; ``reset`` and
    ``enable`` are the gates of sequential nodes; ``pair`` takes [port 0, port 1,
    type], of which ``pair_types`` are those of arithmetic, compare and shift
    nodes; ``port_scale`` has a row for each port, 1 for ports beyond; ``update``
    takes [node, sum], ``edge`` [source, edge].
    """

    data: list[Dense]
    control: list[Dense]
    attention: Dense
    gate: list[Dense]
    mix: np.ndarray
    reset: Dense
    enable: Dense
    pair_types: np.ndarray
    pair: list[Dense]
    port_scale: np.ndarray
    update: list[Dense]
    edge: list[Dense]

    @property
    def dims(self) -> int:
        return self.port_scale.shape[1]


def _through(layers: list[Dense], x: np.ndarray) -> np.ndarray:
    for layer in layers:
        x = layer(x)
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _normed(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _layout(dims: int) -> Layout:
    # sums by type, of both ports and of memory; messages, and control messages among them
    return Layout((len(EDGE_TYPES) + 3) * dims + 2, dims, 1, dims)


def accumulated_messages(edges: DataFrame, w: GatedWeights) -> DataFrame:
    """(graph, dst, acc) of edges (graph, dst, edge_type, target_port, x, e), x the vector of the source."""
    dims, layout = w.dims, _layout(w.dims)

    def parts(batch: pa.RecordBatch) -> np.ndarray:
        kind, port = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("edge_type", "target_port"))
        both = np.concatenate([_vectors(batch.column("x"), dims), _vectors(batch.column("e"), dims)], 1)
        control = kind == _CONTROL
        m = np.where(control[:, None], _through(w.control, both), _through(w.data, both))
        scale = np.where((port < len(w.port_scale))[:, None], w.port_scale[np.minimum(port, len(w.port_scale) - 1)], 1.0)
        memory = m * scale * np.isin(kind, (_DATA, _ENABLE))[:, None]
        by_type = [m * (kind == k)[:, None] for k in range(len(EDGE_TYPES))]
        counts = np.stack([np.ones(len(m)), control.astype(float)], 1)
        sums = np.concatenate([*by_type, m * (port == 0)[:, None], m * (port == 1)[:, None], memory, counts], 1)
        return layout.join(sums, np.maximum(m, 0), w.attention(both), np.ones((len(m), 1)), m[:, None, :])

    rows = edges.select("graph", "dst", "edge_type", F.coalesce("target_port", F.lit(0)).alias("target_port"), "x", "e")
    return accumulate(rows, ["graph", "dst"], layout, parts)


def routed(acc: np.ndarray, node_type: np.ndarray, w: GatedWeights) -> np.ndarray:
    """What each node takes of its accumulated messages, by its type; control edges come before the type."""
    dims, layout = w.dims, _layout(w.dims)
    sums, most, _, total, mixed = layout.split(acc)
    each = [sums[:, k * dims : (k + 1) * dims] for k in range(len(EDGE_TYPES) + 3)]
    degree, controls = sums[:, -2:-1], sums[:, -1]
    port_a, port_b, memory = each[len(EDGE_TYPES) :]
    gates = _softmax(_through(w.gate, each[_CONTROL]))
    chosen = gates[:, :1] * each[_TRUE] + gates[:, 1:] * each[_FALSE] + each[_DATA] + each[_CLOCK] + each[_RESET] + each[_ENABLE]
    reset, enable = w.reset(each[_RESET]), w.enable(each[_ENABLE])
    sequential = reset * each[_RESET] + (1 - reset) * (enable * each[_DATA] + (1 - enable) * each[_CLOCK])
    mean = sum(each[: len(EDGE_TYPES)]) / np.maximum(degree, 1)
    attended = np.divide(mixed[:, 0], total, out=np.zeros(mean.shape), where=total > 0)
    mix = _softmax(w.mix)[np.array(AGG_GROUPS)[node_type]]
    out = mix[:, :1] * attended + mix[:, 1:2] * mean + mix[:, 2:] * most
    for name, vector in zip(("ARITHMETIC", "COMPARE", "SHIFT"), w.pair_types):
        at = node_type == NODE_TYPES.index(name)
        out[at] = _through(w.pair, np.concatenate([port_a[at], port_b[at], np.tile(vector, (at.sum(), 1))], 1))
    for name, made in (("MEMORY", memory), ("SEQUENTIAL", sequential)):
        at = node_type == NODE_TYPES.index(name)
        out[at] = made[at]
    out[controls > 0] = chosen[controls > 0]
    return out


def update_nodes(nodes: DataFrame, acc: DataFrame, w: GatedWeights) -> DataFrame:
    """``nodes`` (graph, node, node_type, x) after the layer: normalised sum of x and MLP([x, routed messages])."""
    dims, layout = w.dims, _layout(w.dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("x"), dims)
            there = batch.column("acc").is_valid().to_numpy(zero_copy_only=False)
            held = np.zeros((len(x), layout.width))
            held[there] = _vectors(batch.column("acc").drop_null(), layout.width)
            out = routed(held, batch.column("node_type").to_numpy(), w)
            x = _normed(x + _through(w.update, np.concatenate([x, out], 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("graph", "node", "node_type")), _lists(x)], names=["graph", "node", "node_type", "x"])

    met = nodes.join(acc.withColumnRenamed("dst", "node"), ["graph", "node"], "left").select("graph", "node", F.col("node_type").cast("int"), "x", "acc")
    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("graph", "node", "node_type"))
    return met.mapInArrow(run, f"{kinds}, x array<double>")


def at_source(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with ``x``, the vector of their source; edges without one go."""
    return edges.join(nodes.select("graph", F.col("node").alias("src"), F.col("x").cast("array<double>").alias("x")), ["graph", "src"])


def update_edges(edges: DataFrame, w: GatedWeights) -> DataFrame:
    """Edges with their source's new vector ``x``: e becomes the normalised sum of e and MLP([x, e])."""
    dims = w.dims
    at = edges.columns.index("e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _vectors(batch.column("e"), dims)
            e = _normed(e + _through(w.edge, np.concatenate([_vectors(batch.column("x"), dims), e], 1)))
            yield pa.RecordBatch.from_arrays([_lists(e) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema)
    return edges.mapInArrow(run, kinds)


def gated_layers(nodes: DataFrame, edges: DataFrame, layers: list[GatedWeights]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after all layers.

    ``nodes``: graph, node, node_type, x; ``edges``: graph, src, dst, edge_type,
    target_port, e.  A node without messages routes zeros; edges whose source is
    no node are not part of the graph.
    """
    edges = edges.select("graph", "src", "dst", "edge_type", "target_port", F.col("e").cast("array<double>").alias("e"))
    nodes = written_once(nodes.select("graph", "node", "node_type", F.col("x").cast("array<double>").alias("x")), "nodes")
    state = at_source(edges, nodes)
    for w in layers:
        state = written_once(state, "edges")  # read for messages and for the update
        nodes = written_once(update_nodes(nodes, accumulated_messages(state, w), w), "nodes")
        state = update_edges(at_source(state.drop("x"), nodes), w)
    return nodes, state.drop("x")
