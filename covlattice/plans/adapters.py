"""Views over the star schema that play samples, coverage, graphs, boxes and predictions.

Each has its SQL twin in :mod:`covlattice.plans.sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covlattice.functions.scalar import sigmoid

#: Codes of the small vocabularies of the star schema, in alphabetical order.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FLAGS = ["A", "N", "R"]
#: Places of an embedding.
DIMS = 64
UNIVERSES = {"line": 25, "condition": 5, "toggle": 6, "fsm": 3, "branch": 50}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(column: str, values: list[str]):
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)).cast("int") - 1


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed coverage of customers; their nation is the module."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    met = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    met = met.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    ids = {
        "line": F.substring("p_brand", 7, 9).cast("int") - 1,
        "condition": F.substring("o_orderpriority", 1, 1).cast("int") - 1,
        "toggle": _code("p_type", PART_TYPES),
        "fsm": _code("l_returnflag", FLAGS),
        "branch": F.col("p_size") - 1,
    }
    each = F.array(*[F.struct(F.lit(c).alias("ctype"), F.lit(UNIVERSES[c]).alias("n_elements"), i.alias("element_id")) for c, i in ids.items()])
    return met.select(F.col("c_nationkey").alias("module"), F.col("c_custkey").alias("sample"), F.explode(each).alias("e")).select("module", "sample", "e.*")


def stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples (test_id, module): line items, by order and by the supplier's nation."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    met = li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.select(F.col("l_orderkey").alias("test_id"), F.col("s_nationkey").alias("module"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multigraph from suppliers to parts, in eight graphs."""
    status = _code("l_linestatus", ["F", "O"])
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 8).alias("graph"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"),
        (2 * _code("l_returnflag", FLAGS) + status).alias("edge_type"),
        (F.col("l_linenumber") - 1).alias("target_port"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"),
        F.col("l_orderkey").alias("order_key"),
        (F.col("l_extendedprice") / 7919).alias("m"),
        (F.col("l_discount") * 10).alias("score"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in their graph, parts of size up to 45 in each graph that uses them."""
    e = edges(spark, sf_dir)
    part = table(spark, sf_dir, "part").where("p_size <= 45").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node"), (F.col("p_size") % 12).alias("node_type"))
    used = e.select("graph", F.col("dst").alias("node")).distinct().join(part, "node")
    suppliers = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") % 8).alias("graph"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.lit(0).alias("node_type")
    )
    return used.select("graph", "node", "node_type").unionByName(suppliers)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ctype, pred, target, weight): prices guessed from part and quantity; no target on seventh lines."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    met = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.get(F.array(F.lit("line"), F.lit("condition"), F.lit("toggle")), _code("l_returnflag", FLAGS))
    return met.select(
        kind.alias("ctype"),
        (F.col("l_quantity") * F.col("p_retailprice") / 100000).alias("pred"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 100000).alias("target"),
        (1 + F.col("l_discount")).alias("weight"),
    )


def box_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, sample, ctype, center, radius, truth, pred): five boxes of five axes, and guesses of their truth, from each vector."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("module"), F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("e"))
    kinds = F.array(*[F.struct(F.lit(c).alias("ctype"), F.lit(k).alias("k")) for k, c in enumerate(UNIVERSES)])
    return v.select("module", "sample", "e", F.explode(kinds).alias("t")).select(
        "module",
        "sample",
        F.col("t.ctype").alias("ctype"),
        F.transform(F.slice("e", F.col("t.k") * 5 + 1, 5), lambda x: x * 4).alias("center"),
        F.transform(F.slice("e", F.col("t.k") * 5 + 26, 5), lambda x: x * 4).alias("radius"),
        F.least(F.lit(1.0), F.abs(F.get("e", F.col("t.k") + 50)) * 2).alias("truth"),
        sigmoid(F.get("e", F.col("t.k") + 55) * 4).alias("pred"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, position, role, text): turns of conversations as blocks."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("position"), "role", "text")
