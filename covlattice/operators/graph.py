"""Graph records as tables, and message passing as joins and groupings.

Nodes are rows ``graph, node, ...`` and edges rows ``graph, src, dst, ...``;
the graph key stands where a batch would shift its ids.  A vector is an array
column; sums of vectors go by place with :func:`vector_sum`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covlattice.functions.scalar import softmax_row
from covlattice.functions.vocab import EDGE_TYPES, NODE_TYPES, asm_edge_code, asm_node_code, cell_code, edge_code, node_code
from covlattice.functions.text import format_block
from covlattice.operators.joins import join_counted
from covlattice.session import tasks_for, written_once

_DATA, _TRUE, _FALSE, _CONTROL, _CLOCK, _RESET, _ENABLE = range(len(EDGE_TYPES))


def rtl_nodes(graphs: DataFrame) -> DataFrame:
    """(graph, node, position, cell, node_type, width) of whole RTL records (graph, nodes, edges)."""
    n = graphs.select("graph", F.posexplode("nodes").alias("position", "n"))
    return n.select(
        "graph", F.col("n.id").alias("node"), "position", cell_code(F.col("n.cell_type")).alias("cell"),
        node_code(F.col("n.cell_type")).alias("node_type"), F.coalesce("n.width", F.lit(1)).alias("width"),
    )


def rtl_edges(graphs: DataFrame) -> DataFrame:
    """(graph, position, src, dst, edge_type, width, source_port, target_port, valid).

    ``valid`` is false where an end is not a node of the graph; such edges are
    not part of the graph, but keep their place for the labels.
    """
    e = graphs.select("graph", F.posexplode("edges").alias("position", "e"))
    e = e.select(
        "graph", "position", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), edge_code(F.col("e.type")).alias("edge_type"),
        F.coalesce("e.width", F.lit(1)).alias("width"), F.coalesce("e.source_port_idx", F.lit(0)).alias("source_port"),
        F.coalesce("e.target_port_idx", F.lit(0)).alias("target_port"),
    )
    return mark_valid(e, rtl_nodes(graphs).select("graph", "node"))


def mark_valid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with ``valid``: both ends are among ``nodes`` (graph, node)."""
    known = nodes.select("graph", "node").distinct()
    src = known.select("graph", F.col("node").alias("src"), F.lit(True).alias("has_src"))
    dst = known.select("graph", F.col("node").alias("dst"), F.lit(True).alias("has_dst"))
    met = edges.join(src, ["graph", "src"], "left").join(dst, ["graph", "dst"], "left")
    return met.withColumn("valid", F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()).drop("has_src", "has_dst")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist: two semi joins, of as many tasks as the counted edges need."""
    known, parts = nodes.select("graph", "node"), tasks_for(edges)
    for end in ("src", "dst"):
        edges = edges.repartition(parts, "graph", end).join(known.withColumnRenamed("node", end), ["graph", end], "left_semi")
    return edges


def asm_nodes(graphs: DataFrame) -> DataFrame:
    """(graph, node, position, node_type, text) of ASM records; a graph without nodes gives one of type 0."""
    n = graphs.select("graph", F.posexplode_outer(F.map_entries("nodes")).alias("position", "n"))
    return n.select(
        "graph", F.coalesce("n.key", F.lit("")).alias("node"), F.coalesce("position", F.lit(0)).alias("position"),
        F.when(F.col("n").isNull(), 0).otherwise(asm_node_code(F.col("n.value.node_type"))).alias("node_type"),
        format_block(F.col("n.value.instructions")).alias("text"),
    )


def asm_edges(graphs: DataFrame) -> DataFrame:
    """(graph, src, dst, edge_type) with both ends known."""
    e = graphs.select("graph", F.explode("edges").alias("e"))
    e = e.select("graph", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), asm_edge_code(F.col("e.edge_type")).alias("edge_type"))
    return valid_edges(e, asm_nodes(graphs))


def long_labels(samples: DataFrame) -> DataFrame:
    """(sample, position, at, label) of nested labels array<struct<edge_id, label>>."""
    return samples.select("sample", F.posexplode("labels").alias("at", "l")).select(
        "sample", F.col("l.edge_id").alias("position"), "at", F.col("l.label").alias("label")
    )


def dense_edge_labels(edges: DataFrame, samples: DataFrame, given: DataFrame, default: int = -1, salts: int = 64) -> DataFrame:
    """(sample, graph, position, label) of valid edges.

    ``samples`` has sample, graph, default_label; ``given`` (sample, position,
    at, label): of several labels of an edge the last counts; positions without
    an edge count for nothing; a null default is ``default``.  Few graphs hold
    very many edges, so the edges of a graph are dealt to ``salts`` tasks by
    position, and its samples are repeated for each.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt_")
    each = samples.select("sample", "graph", F.coalesce("default_label", F.lit(default)).alias("d"), every)
    last = given.groupBy("sample", "position").agg(F.max_by("label", "at").alias("given"))
    kept = edges.where("valid").select("graph", "position", F.pmod(F.hash("position"), F.lit(salts)).alias("salt_"))
    met = each.join(kept, ["graph", "salt_"]).join(last, ["sample", "position"], "left")
    return met.select("sample", "graph", "position", F.coalesce("given", "d").alias("label"))


def graph_targets(samples: DataFrame, order: list[str]) -> DataFrame:
    """(sample, y): shares from percent values (a map), null where a type has none."""
    values = F.coalesce(F.col("values"), F.create_map().cast("map<string,double>"))
    return samples.select("sample", F.array(*[F.element_at(values, F.lit(c)) / 100 for c in order]).alias("y"))


# --- message passing -------------------------------------------------------------------------


def gather(edges: DataFrame, features: DataFrame, side: str = "src", column: str = "x") -> DataFrame:
    """``edges`` with the feature column of the node at one end."""
    return edges.join(features.select("graph", F.col("node").alias(side), column), ["graph", side])


def embed(rows: DataFrame, weights: DataFrame, code: str, out: str) -> DataFrame:
    """Rows of a weight table (code, vector) by code; the table has a row for each code of a vocabulary."""
    table = weights.select(F.col("code").alias(code), F.col("vector").alias(out))
    return rows.join(F.broadcast(table), code, "left")


def vector_sum(rows: DataFrame, keys: list[str], column: str = "x", where: Column | None = None, out: str | None = None) -> DataFrame:
    """Sum of the vectors of a group, place by place; partial sums are made before the shuffle."""
    chosen = rows if where is None else rows.where(where)
    long = chosen.select(*keys, F.posexplode(column).alias("dim", "v")).groupBy(*keys, "dim").agg(F.sum("v").alias("v"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda p: p["v"]).alias(out or column))


def segment_sum_by_type(messages: DataFrame, value: str = "m", kinds: list[str] = EDGE_TYPES) -> DataFrame:
    """Per target node one sum for each edge type, 0 where there is none."""
    return messages.groupBy("graph", "dst").agg(
        *[F.coalesce(F.sum(F.when(F.col("edge_type") == k, F.col(value))), F.lit(0.0)).alias(f"sum_{name.lower()}") for k, name in enumerate(kinds)]
    )


def segment_mean_max(messages: DataFrame, value: str = "m") -> DataFrame:
    """Per target node sum, mean, in-degree, and the maximum that starts from 0."""
    return messages.groupBy("graph", "dst").agg(
        F.sum(value).alias("all_sum"), F.avg(value).alias("all_mean"), F.greatest(F.lit(0.0), F.max(value)).alias("all_max"), F.count("*").alias("degree")
    )


#: Scores of a step share a factor, so that their exponentials can be summed before the largest score is known.
SCORE_STEP = 64


def softmax_totals(edges: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(keys, top, total, n): the largest score of a group, the sum of exp(score - top), and the rows.

    Scores are summed by steps of ``SCORE_STEP``, each about its own factor, in
    groupings with partial sums; the steps of a group are merged as pairs of
    maximum and sum, so no row is joined back to its maximum.
    """
    step = F.floor(F.col(score) / SCORE_STEP)
    parts = edges.groupBy(*keys, step.alias("step_")).agg(
        F.max(score).alias("top_"), F.sum(F.exp(F.col(score) - step * SCORE_STEP)).alias("sum_"), F.count(F.lit(1)).alias("n_")
    )
    top = F.max("top_")
    merged = F.collect_list(F.struct("step_", "sum_"))  # as many as a group's scores span steps
    total = lambda t: F.aggregate("steps_", F.lit(0.0), lambda a, p: a + p["sum_"] * F.exp(p["step_"] * SCORE_STEP - t))
    held = parts.groupBy(*keys).agg(top.alias("top"), merged.alias("steps_"), F.sum("n_").alias("n"))
    return held.select(*keys, "top", total(F.col("top")).alias("total"), "n")


def attention_softmax(edges: DataFrame, score: str = "score") -> DataFrame:
    """``attention``: softmax of the scores of the edges into a node.

    Maximum and sum come in one pass (:func:`softmax_totals`) and are joined
    back once; a node with very many in-edges is met by broadcast.
    """
    met = join_counted(edges, softmax_totals(edges, ["graph", "dst"], score), ["graph", "dst"], "n")
    return met.withColumn("attention", F.exp(F.col(score) - F.col("top")) / F.col("total")).drop("top", "total")


def _port_scaled(messages: DataFrame, scale: DataFrame | None) -> DataFrame:
    """``messages`` with ``port_scale``, the factor of their port; 1 without one."""
    if scale is None:
        return messages.withColumn("port_scale", F.lit(1.0))
    factors = scale.select(F.col("code").alias("target_port"), F.col("scale").alias("port_scale"))
    return messages.join(F.broadcast(factors), "target_port", "left").withColumn("port_scale", F.coalesce("port_scale", F.lit(1.0)))


def port_sums(messages: DataFrame, value: str = "m", scale: DataFrame | None = None) -> DataFrame:
    """Sums over port 0 and port 1, and a sum of data and enable messages scaled by their port."""
    scaled = _port_scaled(messages, scale)
    sum_if = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))
    return scaled.groupBy("graph", "dst").agg(
        sum_if(F.col("target_port") == 0, F.col(value)).alias("port_a"),
        sum_if(F.col("target_port") == 1, F.col(value)).alias("port_b"),
        sum_if(F.col("edge_type").isin(_DATA, _ENABLE), F.col(value) * F.col("port_scale")).alias("mem"),
    )


def routed_aggregate(
    messages: DataFrame, nodes: DataFrame, gates: dict[str, Column] | None = None, value: str = "m", scale: DataFrame | None = None,
    pair: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(graph, node, node_type, out): each node type aggregates its messages in its own way.

    Messages have graph, dst, edge_type, target_port, the value and
    ``attention``.  By rising priority: a mix of attention sum, mean and
    maximum; ports for shift, compare and arithmetic nodes; data and enable
    messages for memory; nested gates reset > enable > data for sequential nodes; and, with
    any control edge, the gated true / false branches plus what bypasses them.
    ``gates`` gives alpha_true, alpha_false, reset, enable (columns over the
    sums) and mix (an array of three); without learned ones they are sigmoids
    and softmaxes of the sums themselves.  ``scale`` (code, scale) multiplies a
    memory message by its port's factor, 1 without one.  ``pair`` adds a column
    ``pair`` to rows with node_type, port_a and port_b (0 without messages), say
    by dense layers over both and the type's vector; without it, shift, compare
    and arithmetic nodes have port_a - port_b, which is no learned function.
    """
    kinds = {name.lower(): k for k, name in enumerate(EDGE_TYPES)}
    m = F.col(value)
    sum_of = lambda cond: F.coalesce(F.sum(F.when(cond, m)), F.lit(0.0))
    scaled = _port_scaled(messages, scale)
    sums = scaled.groupBy("graph", "dst").agg(
        *[sum_of(F.col("edge_type") == k).alias(n) for n, k in kinds.items()],
        F.coalesce(F.sum(F.when(F.col("edge_type").isin(_DATA, _ENABLE), m * F.col("port_scale"))), F.lit(0.0)).alias("mem"),
        F.bool_or(F.col("edge_type") == _CONTROL).alias("has_control"),
        sum_of(F.col("target_port") == 0).alias("port_a"),
        sum_of(F.col("target_port") == 1).alias("port_b"),
        F.sum(m * F.col("attention")).alias("attention_sum"),
        F.avg(m).alias("all_mean"),
        F.greatest(F.lit(0.0), F.max(m)).alias("all_max"),
    )
    sig = lambda c: 1 / (1 + F.exp(-F.col(c)))
    g = {
        "alpha_true": sig("control"), "alpha_false": 1 - sig("control"), "reset": sig("reset"), "enable": sig("enable"),
        "mix": softmax_row(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))),
    } | (gates or {})
    c = F.col
    mux = g["alpha_true"] * c("data_true") + g["alpha_false"] * c("data_false") + (c("data") + c("clock") + c("reset") + c("enable"))
    seq = g["reset"] * c("reset") + (1 - g["reset"]) * (g["enable"] * c("data") + (1 - g["enable"]) * c("clock"))
    ports = c("port_a") - c("port_b") if pair is None else c("pair")
    mix = g["mix"]
    default = F.get(mix, F.lit(0)) * c("attention_sum") + F.get(mix, F.lit(1)) * c("all_mean") + F.get(mix, F.lit(2)) * c("all_max")
    kind = lambda *names: c("node_type").isin(*[NODE_TYPES.index(n) for n in names])
    out = (
        F.when(c("has_control"), mux)
        .when(kind("SEQUENTIAL"), seq)
        .when(kind("MEMORY"), c("mem"))
        .when(kind("ARITHMETIC", "COMPARE", "SHIFT"), ports)
        .otherwise(default)
    )
    typed = nodes.select("graph", F.col("node").alias("dst"), "node_type")
    met = typed.join(sums, ["graph", "dst"], "left")
    if pair is not None:
        met = pair(met.withColumns({p: F.coalesce(p, F.lit(0.0)) for p in ("port_a", "port_b")}))
    met = met.withColumn("out", F.coalesce(out, F.lit(0.0)))
    return met.select("graph", F.col("dst").alias("node"), "node_type", "out")


def _with_degrees(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Written edges (graph, src, dst) with a loop at every node, (graph, node, d) of what is met by any, and the tasks for both."""
    loops = nodes.select("graph", F.col("node").alias("src"), F.col("node").alias("dst"))
    full = written_once(edges.select("graph", "src", "dst").unionByName(loops), "looped_edges")
    deg = full.groupBy("graph", F.col("dst").alias("node")).agg(F.count("*").alias("d"))
    return full, written_once(deg, "degrees"), tasks_for(full)  # written, or edges would be shuffled into as few tasks as the degrees


def _at_both(full: DataFrame, src: DataFrame, dst: DataFrame, parts: int) -> DataFrame:
    """``full`` with the columns of ``src`` and ``dst`` (graph, node, ...) at its ends; it is left in parts by target."""
    met = full.repartition(parts, "graph", "src").join(src.withColumnRenamed("node", "src"), ["graph", "src"])
    return met.repartition(parts, "graph", "dst").join(dst.withColumnRenamed("node", "dst"), ["graph", "dst"])


_NORM = "1 / sqrt(d_src * d_dst)"


def gcn_norm(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges and a loop at every node with ``norm`` = 1 / sqrt(d_src d_dst), degrees counting the loops."""
    full, deg, parts = _with_degrees(edges, nodes)
    met = _at_both(full, deg.withColumnRenamed("d", "d_src"), deg.withColumnRenamed("d", "d_dst"), parts)
    return met.select("graph", "src", "dst", F.expr(_NORM).alias("norm"))


def gcn_propagate(edges: DataFrame, features: DataFrame) -> DataFrame:
    """One normalised propagation: (graph, node, x) to the same, x a vector.

    Edges meet what is known of their source at once, its degree and its vector,
    and are summed where they have met the degree of their target.
    """
    features = written_once(features.select("graph", "node", "x"), "features")
    full, deg, parts = _with_degrees(edges, features)
    sources = features.join(deg.withColumnRenamed("d", "d_src"), ["graph", "node"])
    met = _at_both(full, sources, deg.withColumnRenamed("d", "d_dst"), parts)
    scaled = met.select("graph", "dst", F.transform("x", lambda v: v * F.expr(_NORM)).alias("x"))
    return vector_sum(scaled, ["graph", "dst"]).select("graph", F.col("dst").alias("node"), "x")


def mean_pool(nodes: DataFrame, column: str = "x") -> DataFrame:
    """(graph, x): mean of the node vectors."""
    long = nodes.select("graph", F.posexplode(column).alias("dim", "v")).groupBy("graph", "dim").agg(F.avg("v").alias("v"))
    return long.groupBy("graph").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda p: p["v"]).alias("x"))


def combine_graphs(rtl: DataFrame, asm: DataFrame, how: str = "concat") -> DataFrame:
    """Graph embeddings side by side (``concat``) or added (``add``)."""
    both = rtl.join(asm.select("graph", F.col("x").alias("y")), "graph")
    if how == "concat":
        return both.select("graph", F.concat("x", "y").alias("x"))
    if how == "add":
        return both.select("graph", F.zip_with("x", "y", lambda a, b: a + b).alias("x"))
    raise ValueError(f"unknown combination: {how}")


def agg_mix(nodes: DataFrame, selector: DataFrame) -> DataFrame:
    """Share of sum, mean and maximum of each node's aggregation group (code, logits)."""
    return nodes.join(F.broadcast(selector.select(F.col("code").alias("agg_group"), "logits")), "agg_group", "left").withColumn("mix", softmax_row(F.col("logits")))


def rank_within(rows: DataFrame, by: str, order: Column, top: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("place") <= top)
