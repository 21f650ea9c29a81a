"""The dual encoder: two graphs of a sample, layer by layer, with cross attention between them.

A layer passes messages in both graphs, then each side reads latents that pool
the other's nodes as they were before either had read.  Node and edge vectors
are tables written between the supersteps.  A step of a graph meets its edges
with their ends, and merges accumulators by target; the fusion merges one
accumulator for each graph and moves no node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covlattice.operators import graph
from covlattice.operators.accumulate import Layout, accumulate
from covlattice.operators.encoder import Dense
from covlattice.operators.fusion import at_nodes
from covlattice.operators.gated import GatedWeights, accumulated_messages, at_source, update_edges, update_nodes
from covlattice.session import cut_lineage


def _through(layers: list[Dense], x: np.ndarray) -> np.ndarray:
    for layer in layers:
        x = layer(x)
    return x


def _normed(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; a null vector is zeros."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    m = np.zeros((len(column), width))
    m[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return m


def mapped(rows: DataFrame, out: str, inputs: dict[str, int], f: Callable[..., np.ndarray], drop: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the vectors ``out`` = f(matrices of the ``inputs``, by name and width); null vectors count as zeros."""
    kept = [c for c in rows.columns if c != out and c not in drop]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = f(*(_matrix(batch.column(c), n) for c, n in inputs.items()))
            ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
            vectors = pa.ListArray.from_arrays(ends, pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), vectors], names=[*kept, out])

    return rows.mapInArrow(run, f"{kinds}, `{out}` array<double>")


def adapted(rows: DataFrame, column: str, layers: list[Dense]) -> DataFrame:
    """Vectors plus a residual: the layers over the normalised vector."""
    return mapped(rows, column, {column: layers[0].weight.shape[1]}, lambda x: x + _through(layers, _normed(x)))


def summed_messages(edges: DataFrame, columns: dict[str, int], f: Callable[..., np.ndarray], dims: int) -> DataFrame:
    """(graph, node, acc): the sum of the vectors f(matrices of the columns) of the edges into a node."""
    layout = Layout(dims, 0, 0, 0)
    rows = edges.select("graph", F.col("dst").alias("node"), *columns)
    return accumulate(rows, ["graph", "node"], layout, lambda batch: f(*(_matrix(batch.column(c), n) for c, n in columns.items())))


def gcn_layer(nodes: DataFrame, normed_edges: DataFrame, layer: Dense) -> DataFrame:
    """(graph, node, ..., x) after a graph convolution with weights: normalised sum of x and GELU(A W x + b).

    ``normed_edges`` (graph, src, dst, norm) are those of :func:`graph.gcn_norm`,
    made once for all layers.  A batch of edges is a block of the sparse matrix:
    its rows are scaled, multiplied by W and summed by target before the shuffle.
    """
    dims, wide = layer.weight.shape
    sent = at_source(normed_edges, nodes).withColumn("n", F.array("norm"))
    acc = summed_messages(sent, {"x": wide, "n": 1}, lambda x, n: (x * n) @ layer.weight.T, dims)
    gelu = Dense(np.eye(dims), layer.bias, "gelu")
    met = nodes.join(acc, ["graph", "node"], "left")
    return mapped(met, "x", {"x": wide, "acc": dims}, lambda x, a: _normed(x + gelu(a)), drop=("acc",))


@dataclass(frozen=True)
class FlowWeights:
    """A layer over a plain graph: ``message`` takes [source, edge], ``edge`` [target, source, edge]."""

    message: list[Dense]
    edge: list[Dense]


def flow_layer(nodes: DataFrame, state: DataFrame, w: FlowWeights) -> tuple[DataFrame, DataFrame]:
    """(nodes, state) after a layer; ``state`` are edges (graph, src, dst, e, x), x the source's vector, and comes back with the new ones."""
    dims = w.message[-1].weight.shape[0]
    both = {"x": dims, "e": dims}
    acc = summed_messages(state, both, lambda x, e: _through(w.message, np.concatenate([x, e], 1)), dims)
    met = nodes.join(acc, ["graph", "node"], "left")
    nodes = cut_lineage(mapped(met, "x", {"x": dims, "acc": dims}, lambda x, a: _normed(x + a), drop=("acc",)))
    ends = at_source(state.drop("x"), nodes).join(nodes.select("graph", F.col("node").alias("dst"), F.col("x").alias("y")), ["graph", "dst"])
    widths = {"y": dims, "x": dims, "e": dims}
    return nodes, cut_lineage(mapped(ends, "e", widths, lambda y, x, e: _normed(e + _through(w.edge, np.concatenate([y, x, e], 1))), drop=("y",)))


@dataclass(frozen=True)
class Attention:
    """Projections of a multi-head attention; the width of ``query`` is divided among ``heads``."""

    query: Dense
    key: Dense
    value: Dense
    out: Dense
    heads: int

    def split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(*x.shape[:-1], self.heads, -1)


@dataclass(frozen=True)
class FusionWeights:
    """Cross attention through ``latents`` (a row each): ``pool`` reads the source, ``read`` the latents; ``gate`` takes [node, context]."""

    latents: np.ndarray
    pool: Attention
    read: Attention
    gate: Dense
    mlp: list[Dense]


def pooled_latents(source: DataFrame, w: FusionWeights) -> DataFrame:
    """(graph, z): the latents of every graph of ``source`` (graph, x), one after the other."""
    k, dims = w.latents.shape
    heads = w.pool.heads
    query = w.pool.split(w.pool.query(w.latents))  # latents, heads, places
    layout = Layout(0, 0, k * heads, query.shape[2])

    def parts(batch: pa.RecordBatch) -> np.ndarray:
        x = _normed(_matrix(batch.column("x"), dims))
        key, value = w.pool.split(w.pool.key(x)), w.pool.split(w.pool.value(x))
        score = np.einsum("khd,nhd->nkh", query, key).reshape(len(x), -1) / np.sqrt(query.shape[2])
        none = np.zeros((len(x), 0))
        return layout.join(none, none, score, np.ones(score.shape), np.repeat(value[:, None], k, 1).reshape(len(x), k * heads, -1))

    def finish(acc: np.ndarray) -> np.ndarray:
        _, _, _, total, mixed = layout.split(acc)
        return w.pool.out((mixed / total[:, :, None]).reshape(len(acc), k, -1)).reshape(len(acc), -1)

    made = accumulate(source.where("x IS NOT NULL").select("graph", "x"), ["graph"], layout, parts)
    return mapped(made, "z", {"acc": layout.width}, finish, drop=("acc",))


def fused(target: DataFrame, z: DataFrame, w: FusionWeights) -> DataFrame:
    """``target`` (graph, node, ..., x) with a gated share of what its nodes read of their graph's latents; no latents are zero latents."""
    k, dims = w.latents.shape

    def run(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        z = z.reshape(len(x), k, dims)
        query, key, value = w.read.split(w.read.query(_normed(x))), w.read.split(w.read.key(z)), w.read.split(w.read.value(z))
        score = np.einsum("nhd,nkhd->nhk", query, key) / np.sqrt(query.shape[2])
        weight = np.exp(score - score.max(2, keepdims=True))
        read = np.einsum("nhk,nkhd->nhd", weight / weight.sum(2, keepdims=True), value)
        context = _normed(w.read.out(read.reshape(len(x), -1)))
        return x + w.gate(np.concatenate([x, context], 1)) * _through(w.mlp, context)

    return mapped(at_nodes(target, z), "x", {"x": dims, "z": k * dims}, run, drop=("z",))


@dataclass(frozen=True)
class DualLayer:
    """A gated layer of one graph, a flow layer of the other, and the fusion into each (None: no fusion)."""

    gated: GatedWeights
    flow: FlowWeights
    into_gated: FusionWeights | None = None
    into_flow: FusionWeights | None = None


def dual_encode(
    nodes: DataFrame, edges: DataFrame, flow_nodes: DataFrame, flow_edges: DataFrame, layers: list[DualLayer]
) -> tuple[DataFrame, DataFrame]:
    """(nodes, flow_nodes) after all layers.

    ``nodes``: graph, node, node_type, x; ``edges``: graph, src, dst, edge_type,
    target_port, e; ``flow_nodes``: graph, node, x; ``flow_edges``: graph, src,
    dst, e.  ``graph`` names the sample in both.  A sample without one graph
    keeps the other.
    """
    state = cut_lineage(at_source(edges.select("graph", "src", "dst", "edge_type", "target_port", "e"), nodes))
    flow_state = cut_lineage(at_source(flow_edges.select("graph", "src", "dst", "e"), flow_nodes))
    nodes, flow_nodes = nodes.select("graph", "node", "node_type", "x"), flow_nodes.select("graph", "node", "x")
    for layer in layers:
        flow_nodes, flow_state = flow_layer(flow_nodes, flow_state, layer.flow)
        nodes = cut_lineage(update_nodes(nodes, accumulated_messages(state, layer.gated), layer.gated))
        state = update_edges(at_source(state.drop("x"), nodes), layer.gated)
        before, flow_before = nodes, flow_nodes
        if layer.into_gated is not None:
            nodes = cut_lineage(fused(before, cut_lineage(pooled_latents(flow_before, layer.into_gated)), layer.into_gated))
            state = at_source(state.drop("x"), nodes)  # messages of the next layer read what the fusion made
        if layer.into_flow is not None:
            flow_nodes = cut_lineage(fused(flow_before, cut_lineage(pooled_latents(before, layer.into_flow)), layer.into_flow))
            flow_state = cut_lineage(at_source(flow_state.drop("x"), flow_nodes))
        state = cut_lineage(state)
    return nodes, flow_nodes


def graph_vectors(nodes: DataFrame, flow_nodes: DataFrame, how: str = "concat") -> DataFrame:
    """(graph, x): the mean node vectors of both graphs of a sample, side by side or added."""
    return graph.combine_graphs(graph.mean_pool(nodes), graph.mean_pool(flow_nodes), how)
