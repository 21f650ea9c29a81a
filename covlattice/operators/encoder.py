"""Forward passes with given weights: dense layers, feature encoders, message layers, heads.

Weights are numpy arrays and part of the settings (their size does not depend
on the data); each task applies them to batches of vectors.  Layers pass
messages by joins and groupings of :mod:`covlattice.operators.graph` and cut
their lineage one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covlattice.functions.scalar import layer_norm, width_code
from covlattice.operators import graph
from covlattice.session import cut_lineage


def erf(x: np.ndarray) -> np.ndarray:
    """The error function: its series of terms of one sign, which is exact to rounding; 1 beyond 6."""
    near = np.clip(x, -6, 6)
    square, term = 2 * near * near, near.astype(float)
    total, n = term.copy(), 0
    while np.abs(term).max(initial=0) > 1e-17 * max(1e-300, np.abs(total).max(initial=0)) and n < 400:
        n += 1
        term = term * square / (2 * n + 1)
        total = total + term
    return np.clip(2 / math.sqrt(math.pi) * np.exp(-near * near) * total, -1, 1)


@dataclass(frozen=True)
class Dense:
    """y = act(W x + b); ``act``: none, relu, gelu or sigmoid."""

    weight: np.ndarray
    bias: np.ndarray
    act: str = "none"

    def __post_init__(self) -> None:
        if self.act not in ("none", "relu", "gelu", "sigmoid") or self.weight.shape[0] != self.bias.shape[0]:
            raise ValueError("unknown activation, or weight and bias do not match")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weight.T + self.bias
        if self.act == "relu":
            return np.maximum(y, 0)
        if self.act == "sigmoid":
            return 1 / (1 + np.exp(-y))
        if self.act == "gelu":
            return 0.5 * y * (1 + erf(y / math.sqrt(2)))
        return y


def dense(rows: DataFrame, column: str, layers: list[Dense], out: str | None = None) -> DataFrame:
    """``rows`` with ``out``: the layers one after the other over the vectors of ``column``.

    Other columns pass through; all vectors have the first layer's width; a
    null vector gives null.
    """
    out = out or column
    kept = [c for c in rows.columns if c != out]
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    chosen = rows.select(*kept, F.col(column).cast("array<double>").alias("vector_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector_")
            there = vectors.is_valid()
            x = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, layers[0].weight.shape[1])
            for layer in layers:
                x = layer(x)
            sizes = np.where(there.to_numpy(zero_copy_only=False), x.shape[1], 0)
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            column_ = pa.ListArray.from_arrays(ends, pa.array(x.ravel()), mask=pa.compute.invert(there))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column_], names=[*kept, out])

    return chosen.mapInArrow(run, f"{types}, `{out}` array<double>")


def node_features(nodes: DataFrame, cells: DataFrame, width_weight: list[float]) -> DataFrame:
    """(graph, node, x): normalised sum of a cell's vector (code, vector) and the log width times a weight."""
    met = graph.embed(nodes, cells, "cell", "e")
    width = F.array(*[F.lit(float(w)) for w in width_weight])
    scaled = F.transform(width, lambda w: w * width_code(F.col("width")))
    return met.select("graph", "node", layer_norm(F.zip_with("e", scaled, lambda a, b: a + b)).alias("x"))


def edge_features(edges: DataFrame, kinds: DataFrame, ports: DataFrame, width_weight: list[float]) -> DataFrame:
    """``edges`` with ``e``: type vector plus log width, then the vectors of both ports."""
    met = graph.embed(graph.embed(graph.embed(edges, kinds, "edge_type", "k"), ports, "source_port", "p"), ports, "target_port", "q")
    width = F.array(*[F.lit(float(w)) for w in width_weight])
    typed = F.zip_with("k", F.transform(width, lambda w: w * width_code(F.col("width"))), lambda a, b: a + b)
    zero = F.transform(width, lambda w: F.lit(0.0))
    return met.withColumn("e", F.concat(typed, F.coalesce("p", zero), F.coalesce("q", zero))).drop("k", "p", "q")


def message_layer(nodes: DataFrame, edges: DataFrame, message: list[Dense], update: list[Dense]) -> DataFrame:
    """(graph, node, x) after one layer: the messages MLP([x_src, e]) are summed, MLP([x, sum]) is added."""
    sent = graph.gather(edges.select("graph", "src", "dst", "e"), nodes)
    sent = dense(sent.select("graph", "dst", F.concat("x", "e").alias("m")), "m", message)
    summed = graph.vector_sum(sent, ["graph", "dst"], "m").select("graph", F.col("dst").alias("node"), "m")
    zero = F.array_repeat(F.lit(0.0), message[-1].weight.shape[0])
    met = nodes.join(summed, ["graph", "node"], "left").select("graph", "node", "x", F.concat("x", F.coalesce("m", zero)).alias("u"))
    return dense(met, "u", update).select("graph", "node", layer_norm(F.zip_with("x", "u", lambda a, b: a + b)).alias("x"))


def edge_update(edges: DataFrame, nodes: DataFrame, layers: list[Dense]) -> DataFrame:
    """Edges with ``e`` made anew from both ends and itself."""
    ends = graph.gather(edges, nodes.withColumnRenamed("x", "a"), "src", "a")
    ends = graph.gather(ends, nodes.withColumnRenamed("x", "b"), "dst", "b")
    return dense(ends.withColumn("e", F.concat("a", "b", "e")).drop("a", "b"), "e", layers)


def encode(nodes: DataFrame, edges: DataFrame, layers: list[tuple[list[Dense], list[Dense]]]) -> DataFrame:
    """(graph, x): all message layers, then the mean over the nodes."""
    for message, update in layers:
        nodes = cut_lineage(message_layer(nodes, edges, message, update))
    return graph.mean_pool(nodes)


def coverage_head(graphs: DataFrame, layers: list[Dense]) -> DataFrame:
    """(graph, y): predicted shares, between 0 and 1 by the last layer's sigmoid."""
    return dense(graphs, "x", layers, "y").select("graph", "y")


def hashed_text(rows: DataFrame, dims: int, text: str = "text", out: str = "vector") -> DataFrame:
    """``rows`` with a unit vector of signed counts of hashed words: a stand-in for a language model's encoding."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\W+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dims)))
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda d: (F.size(F.filter(slots, lambda s: s == d)) - F.size(F.filter(slots, lambda s: s == d + dims))).cast("double"),
    )
    made = rows.withColumn(out, counts)
    norm = F.sqrt(F.aggregate(out, F.lit(0.0), lambda a, v: a + v * v))
    return made.withColumn(out, F.transform(out, lambda v: F.coalesce(F.try_divide(v, norm), F.lit(0.0))))


def token_pool(tokens: DataFrame, pooling: str = "mean") -> DataFrame:
    """(text_id, x) of (text_id, position, attended, x): mean of the attended tokens, or the first token."""
    if pooling == "cls":
        return tokens.groupBy("text_id").agg(F.min_by("x", "position").alias("x"))
    if pooling != "mean":
        raise ValueError(f"unknown pooling: {pooling}")
    used = tokens.where("attended")
    counts = used.groupBy("text_id").agg(F.count("*").alias("n"))
    return graph.vector_sum(used, ["text_id"]).join(counts, "text_id").select("text_id", F.transform("x", lambda v: v / F.col("n")).alias("x"))
