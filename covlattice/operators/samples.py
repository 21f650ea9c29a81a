"""Sample tables: rows that refer to their graphs and carry their labels and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covlattice.functions.vocab import TARGET_ORDER


def restrict(samples: DataFrame, split: DataFrame, validation: bool) -> DataFrame:
    """Samples of one side of a split (test_id, is_val); stimuli that the split does not know are left out."""
    side = F.col("is_val") if validation else ~F.col("is_val")
    return samples.join(split.where(side).select("test_id"), "test_id", "left_semi")


def sample_table(samples: DataFrame, edges: DataFrame, order: list[str] = TARGET_ORDER, default: int = -1) -> DataFrame:
    """(dataset_dir, sample_id, test_id, module_name, rtl_key, asm_key, n_edges, default_label, labels, y).

    ``samples`` come from ``join_graphs``, ``edges`` from ``rtl_edges``.  A
    sample keeps the key of its graph and the labels that differ from its
    default as array<struct<position, label>> by position, not a copy of all
    edges: of several labels of an edge the last counts, and edges that are not
    valid or do not exist are left out.  ``y`` are shares in ``order``, null
    where a type has no value.
    """
    key = ["dataset_dir", "sample_id"]
    covered = F.col("targets.edge_coverage")
    flat = samples.select(*key, "rtl_key", F.posexplode(covered["labels"]).alias("at", "l"))
    last = flat.groupBy(*key, "rtl_key", F.col("l.edge_id").alias("position")).agg(F.max_by("l.label", "at").alias("label"))
    valid = edges.where("valid").select(F.col("graph").alias("rtl_key"), "position")
    kept = last.join(valid, ["rtl_key", "position"], "left_semi")
    each = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", "label"))).alias("labels"))
    sizes = valid.groupBy("rtl_key").agg(F.count("*").alias("n_edges"))
    values = F.coalesce(F.col("targets.graph_coverage.values"), F.create_map().cast("map<string,double>"))
    made = samples.join(each, key, "left").join(sizes, "rtl_key", "left")
    return made.select(
        *key, "test_id", "module_name", "rtl_key", "asm_key", F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
        F.coalesce(covered["default"], F.lit(default)).alias("default_label"),
        F.coalesce("labels", F.array().cast("array<struct<position: int, label: int>>")).alias("labels"),
        F.array(*[F.element_at(values, F.lit(c)) / 100 for c in order]).alias("y"),
    )
