"""Descriptive tables of a dataset: sizes, densities, label and type shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covlattice.operators.order import lower_medians


def module_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, n_nodes, n_edges, density, avg_degree): density is E / (V (V - 1)), degree 2 E / V."""
    v = nodes.groupBy("graph").agg(F.count_distinct("node").alias("n_nodes"))
    e = edges.groupBy("graph").agg(F.count("*").alias("n_edges"))
    met = v.join(e, "graph", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    n, m = F.col("n_nodes").cast("double"), F.col("n_edges").cast("double")
    return met.select("graph", "n_nodes", "n_edges", F.coalesce(F.try_divide(m, n * (n - 1)), F.lit(0.0)).alias("density"), (2 * m / n).alias("avg_degree"))


def type_shares(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, share)."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))  # one row
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("t")).alias("share"))


def label_distribution(labels: DataFrame, by: str = "module") -> DataFrame:
    """Counts of -1, 0 and 1 in each module and over all (module null), the ratio 1 : 0 and the unlabelled share."""
    return labels.rollup(by).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("label") == v).alias(n) for v, n in ((-1, "unlabelled"), (0, "uncovered"), (1, "covered"))],
        F.try_divide(F.count_if(F.col("label") == 1).cast("double"), F.count_if(F.col("label") == 0)).alias("ratio"),
        (F.count_if(F.col("label") == -1) / F.count("*")).alias("unlabelled_share"),
    )


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``column``'s values for each value of ``row``."""
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)


def size_summary(sizes: DataFrame, column: str) -> DataFrame:
    """One row: n, min, max, mean, lower median, population standard deviation."""
    sums = sizes.agg(
        F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std")
    )
    return sums.join(F.broadcast(lower_medians(sizes, column, "median"))).select("n", "min", "max", "mean", "median", "std")  # one row each


def top_types(rows: DataFrame, by: str, column: str, top: int = 4) -> DataFrame:
    """(by, names): the most frequent types of a group, in order, joined by commas."""
    counts = rows.groupBy(by, column).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(by).orderBy(F.col("n").desc(), F.col(column)))
    kept = counts.withColumn("place", place).where(F.col("place") <= top)
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(column).alias("c")))), lambda x: x["c"]), ",").alias("names"))


def histogram(rows: DataFrame, column: str, low: float, width: float, buckets: int) -> DataFrame:
    """(bucket, n): values at the upper end belong to the last bucket."""
    b = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((F.col(column) - low) / width).cast("int")))
    return rows.where(F.col(column).isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def overview(samples: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals."""
    a = samples.agg(F.count("*").alias("n_samples"), F.count_distinct("test_id").alias("n_tests"), F.count_distinct("module").alias("n_modules"))
    b = nodes.select("graph", "node").distinct().agg(F.count("*").alias("n_nodes"))
    c = edges.agg(F.count("*").alias("n_edges"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and Pearson's r; null for a constant side."""
    return rows.agg(F.count("*").alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"))
