"""Cross attention between the nodes of two graphs over a few latents.

A graph's latents pool its nodes (:func:`cross_pool`) and the other graph's nodes
read them (:func:`cross_read`).  Pooling accumulates softmax groups, one for
each latent, in the tasks that hold the nodes; reading needs no exchange of its
own but the latents of a graph, one row of a few vectors, at every node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covlattice.operators.accumulate import Layout, accumulate

#: Graphs are so few that their latents are sent to every task; more are joined by a salted shuffle.
BROADCAST_GRAPHS = 10_000
SALTS = 32


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def pool_latents(source: DataFrame, latents: np.ndarray) -> DataFrame:
    """(graph, z): for every graph of ``source`` (graph, x) the attention of each latent over its nodes, one after the other.

    ``latents`` has a query in each row.  Nodes with a null vector are none; a
    graph of such nodes only has zero vectors.
    """
    k, dims = latents.shape
    layout = Layout(0, 0, k, dims)

    def parts(batch: pa.RecordBatch) -> np.ndarray:
        there = batch.column("x").is_valid().to_numpy(zero_copy_only=False)
        x = np.zeros((batch.num_rows, dims))
        x[there] = _vectors(batch.column("x").drop_null(), dims)
        score = np.where(there[:, None], x @ latents.T / np.sqrt(dims), -np.inf)
        total = np.repeat(there[:, None].astype(float), k, 1)
        return layout.join(np.zeros((len(x), 0)), np.zeros((len(x), 0)), score, total, np.repeat(x[:, None, :], k, 1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            acc = batch.column("acc").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, layout.width)
            _, _, _, total, mixed = layout.split(acc)
            z = np.divide(mixed, total[:, :, None], out=np.zeros(mixed.shape), where=total[:, :, None] > 0)
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * k * dims)
            yield pa.RecordBatch.from_arrays([batch.column("graph"), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=["graph", "z"])

    rows = source.select("graph", F.col("x").cast("array<double>").alias("x"))
    made = accumulate(rows, ["graph"], layout, parts)
    return made.mapInArrow(finish, f"graph {rows.schema['graph'].dataType.simpleString()}, z array<double>")


def cross_pool(source: DataFrame, latents: DataFrame, dims: int) -> DataFrame:
    """Attention of a few latents over a graph's nodes: (graph, latent, x).

    ``latents`` (latent, q) is a setting of a few rows; a graph without nodes has zero vectors.
    """
    few = latents.select("latent", F.col("q").cast("array<double>").alias("q")).orderBy("latent").collect()
    z = pool_latents(source, np.array([r.q for r in few]).reshape(-1, dims))
    kind = latents.schema["latent"].dataType.simpleString()
    names = F.array(*[F.lit(r.latent) for r in few]).cast(f"array<{kind}>")
    each = z.select("graph", F.posexplode(names).alias("k", "latent"), "z")
    return each.select("graph", "latent", F.slice("z", F.col("k") * dims + 1, F.lit(dims)).alias("x"))


def at_nodes(target: DataFrame, z: DataFrame) -> DataFrame:
    """``target`` (graph, ...) with the latents ``z`` of its graph, null where it has none.

    The latents of few graphs are broadcast; else a graph's nodes are dealt to
    ``SALTS`` tasks and its latents repeated for each, so that a graph with a
    third of all nodes is read by many tasks.
    """
    if z.count() <= BROADCAST_GRAPHS:
        return target.join(F.broadcast(z), "graph", "left")
    salted = target.withColumn("salt_", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in target.columns]), F.lit(SALTS)))
    every = z.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(every, ["graph", "salt_"], "left").drop("salt_")


def read_latents(
    target: DataFrame, z: DataFrame, dims: int, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """(graph, node, x): ``combine`` of a node's vectors and of what they read from the latents of their graph.

    A node weighs the latents by a softmax of their products; with no latents, or
    zero ones, it reads zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("x"), dims)
            there = batch.column("z").is_valid().to_numpy(zero_copy_only=False)
            read = np.zeros(x.shape)
            if there.any():
                held = batch.column("z").drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(there.sum()), -1, dims)
                score = np.einsum("nd,nkd->nk", x[there], held) / np.sqrt(dims)
                weight = np.exp(score - score.max(1, keepdims=True))
                read[there] = np.einsum("nk,nkd->nd", weight / weight.sum(1, keepdims=True), held)
            made = combine(x, read)
            ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("graph"), batch.column("node"), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], names=["graph", "node", "x"]
            )

    rows = at_nodes(target.select("graph", "node", F.col("x").cast("array<double>").alias("x")), z)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("graph", "node"))
    return rows.mapInArrow(run, f"{kinds}, x array<double>")


def cross_read(target: DataFrame, pooled: DataFrame, gate: float, dims: int) -> DataFrame:
    """Nodes read the latents (graph, latent, x) of the other graph and add a gated share of what they read.

    A graph whose latents are not there reads zeros and stays as it is.
    """
    z = pooled.groupBy("graph").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("latent", "x"))), lambda p: p["x"])).alias("z"))
    return read_latents(target, z, dims, lambda x, read: x + gate * read)
