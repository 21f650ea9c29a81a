"""Train / validation split by stimulus, without leaking stimuli or emptying a module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covlattice.functions.text import shuffle_key
from covlattice.operators.joins import join_counted
from covlattice.operators.order import running_total
from covlattice.session import cut_lineage, tasks_for, written_once


def stimulus_groups(samples: DataFrame) -> DataFrame:
    """(test_id, n, h, modules array<struct<module, n>>): one row for each stimulus."""
    per = samples.groupBy("test_id", "module").agg(F.count("*").alias("n"))
    return per.groupBy("test_id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("module", "n")).alias("modules"))


def grouped_split(samples: DataFrame, val_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """(test_id, is_val): whole stimuli go to validation, in hash order, until its share is reached.

    Stimuli are taken in seeded hash order as long as the rows before them are
    under the target.  A stimulus that some module could lose its last training
    rows to is skipped: one that holds the module's last ``keep`` rows in that
    order, where keep is the smallest run that the rest leaves.  Concretely each
    module reserves its last stimulus of the order for training.
    """
    total = samples.count()
    if not total:
        raise ValueError("there are no samples to split")
    target = max(1, int(total * val_fraction))
    groups = stimulus_groups(samples).withColumn("h", shuffle_key(F.lit(seed), F.col("test_id")))
    last = groups.select("test_id", "h", F.explode("modules.module").alias("module")).groupBy("module").agg(F.max(F.struct("h", "test_id")).alias("k"))
    reserved = last.select(F.col("k.test_id").alias("test_id")).distinct().withColumn("reserved", F.lit(True))
    free = groups.join(reserved, "test_id", "left").select("test_id", "n", "h", F.coalesce("reserved", F.lit(False)).alias("reserved"))
    placed = running_total(free.withColumn("open_", F.when(F.col("reserved"), 0).otherwise(F.col("n"))), ["h", "test_id"], "open_", "before")
    return placed.select("test_id", (~F.col("reserved") & (F.col("before") < target)).alias("is_val"))


def sequential_split(samples: DataFrame, val_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """(test_id, is_val): the split of one pass over the stimuli, and the same as it.

    The pass takes stimuli in seeded hash order until the validation side has
    its share of the rows; a stimulus after which some module would have no
    training rows is passed over.  Whether one is passed over depends on those
    before it only, so the pass is a fixed point: with the stimuli passed over
    so far, running totals over the whole order say which ones would empty a
    module; the first stimuli are right at once, later ones when those before
    them are, and a round that changes none of the stimuli before the end is the
    pass.  Each round is two running totals, by module and over all stimuli.
    No validation stimulus at all is an error.
    """
    total = samples.count()
    if not total:
        raise ValueError("there are no samples to split")
    target = max(1, int(total * val_fraction))
    order = ["h", "test_id"]
    per = written_once(samples.groupBy("test_id", "module").agg(F.count("*").alias("n")).withColumn("h", shuffle_key(F.lit(seed), F.col("test_id"))), "stimuli")
    parts = tasks_for(per)
    sizes = cut_lineage(per.groupBy("module").agg(F.sum("n").alias("rows"), F.count("*").alias("w_")))
    passed = per.select("test_id").limit(0)
    while True:
        gone = passed.withColumn("gone", F.lit(True))
        held = per.join(gone, "test_id", "left").withColumn("taken", F.when(F.col("gone"), F.lit(0).cast("long")).otherwise(F.col("n")))
        by_module = join_counted(running_total(held, order, "taken", "earlier", ["module"]), sizes, ["module"], "w_")
        empties = by_module.repartition(parts, *order).groupBy(*order).agg(
            F.bool_or(F.col("earlier") + F.col("n") >= F.col("rows")).alias("empties"), F.sum("taken").alias("taken")
        )
        placed = written_once(running_total(empties, order, "taken", "before"), "placed")
        reached = placed.where(F.col("before") < target)
        now = cut_lineage(reached.where("empties").select("test_id"))
        known = passed.join(reached, "test_id", "left_semi")
        if known.join(now, "test_id", "full").count() == known.count() == now.count():
            break
        passed = now
    split = placed.select("test_id", (~F.col("empties") & (F.col("before") < target)).alias("is_val"))
    if split.where("is_val").isEmpty():
        raise ValueError("no stimulus can go to validation while every module keeps training rows")
    return split


def split_diagnostics(samples: DataFrame, split: DataFrame) -> DataFrame:
    """One row: rows, stimuli and modules of both sides, shared stimuli, and modules that only validation has."""
    sided = samples.join(split, "test_id")
    by_module = sided.groupBy("module").agg(F.bool_or("is_val").alias("v"), F.bool_or(~F.col("is_val")).alias("t"))
    modules = by_module.agg(F.count_if("t").alias("train_modules"), F.count_if("v").alias("val_modules"), F.count_if(F.col("v") & ~F.col("t")).alias("val_only_modules"))
    rows = sided.groupBy("test_id", "is_val").agg(F.count("*").alias("n")).groupBy("test_id").agg(
        F.sum(F.when(~F.col("is_val"), F.col("n"))).alias("t"), F.sum(F.when(F.col("is_val"), F.col("n"))).alias("v")
    )
    counts = rows.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("train_rows"), F.coalesce(F.sum("v"), F.lit(0)).alias("val_rows"),
        F.count("t").alias("train_stimuli"), F.count("v").alias("val_stimuli"), F.count_if(F.col("t").isNotNull() & F.col("v").isNotNull()).alias("shared_stimuli"),
    )
    return counts.join(F.broadcast(modules))
