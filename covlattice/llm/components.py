"""Connected components of an undirected graph, as joins and groupings.

Every round points each node at its smallest neighbour, follows the pointers to
their ends and contracts the graph to those ends.  A component loses all its
nodes but local minima in a round, so the rounds are few; pointers and edges
stay in Spark and are written to the checkpoint folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covlattice.llm.common import cut_lineage


def _follow(pointers: DataFrame) -> DataFrame:
    """(u, m) with m replaced by the end of the chain u -> m -> ..."""
    while True:
        ahead = pointers.select(F.col("u").alias("m"), F.col("m").alias("end"))
        jumped = cut_lineage(
            pointers.join(ahead, "m").select("u", F.col("end").alias("m"), (F.col("end") != F.col("m")).alias("moved"))
        )
        if jumped.where("moved").isEmpty():
            return jumped.select("u", "m")
        pointers = jumped.select("u", "m")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, root): root is one node of the component, the same for all of it.

    Nodes without an edge to another node are not listed.  Null ends are no
    edges; repeated edges and edges from a node to itself change nothing.
    """
    edges = cut_lineage(edges.select("a", "b").where("a != b").distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")),
                                              F.struct(F.col("b").alias("u"), F.col("a").alias("w")))).alias("e"))
        nearest = ends.groupBy(F.col("e.u").alias("u")).agg(F.min("e.w").alias("w"))
        pointers = _follow(cut_lineage(nearest.select("u", F.least("u", "w").alias("m"))))
        rounds.append(pointers)
        left = pointers.select(F.col("u").alias("a"), F.col("m").alias("ra"))
        right = pointers.select(F.col("u").alias("b"), F.col("m").alias("rb"))
        kept = edges.join(left, "a").join(right, "b").where("ra != rb")
        edges = cut_lineage(
            kept.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0].select(F.col("u").alias("node"), F.col("m").alias("root"))
    for pointers in rounds[1:]:
        nxt = pointers.select(F.col("u").alias("root"), F.col("m").alias("next"))
        found = found.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
