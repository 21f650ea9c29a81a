"""Dataset directories: a manifest, sample lines and graph files.

Rows keep the directory they came from; samples are known by (dataset_dir,
sample_id), never by position.  A broken manifest is an error, not an empty
dataset.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from covlattice.functions.text import sha_prefix, without_controls
from covlattice.sources import schemas


class DatasetError(ValueError):
    """A dataset directory does not hold what its manifest says."""


def dataset_dirs(given: str | Iterable[str] | None) -> list[str]:
    """One path, several or none as a list without trailing slashes."""
    if given is None:
        return []
    listed = [given] if isinstance(given, str) else list(given)
    return [str(p).rstrip("/") for p in listed]


def read_manifest(spark: SparkSession, directory: str) -> dict:
    """The manifest as it stands; its version is not checked."""
    row = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(f"{directory}/manifest.json").first()
    if row is None:
        raise DatasetError(f"{directory}: no manifest")
    return row.asDict()


def read_samples(spark: SparkSession, directory: str) -> DataFrame:
    """Samples of a directory with dataset_dir, dataset, rtl_path and asm_path.

    Versions, required fields and the manifest's total are checked; blank lines
    are skipped; a missing ASM graph is a null path.
    """
    return read_all_samples(spark, [directory])


def _located(rows: DataFrame, directory: str, manifest: dict) -> DataFrame:
    """Sample rows with dataset_dir, dataset, and the paths of their graphs."""

    def inside(p: Column) -> Column:
        absolute = p.startswith("/") | p.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/")
        return F.when(absolute, p).otherwise(F.concat(F.lit(f"{directory}/"), p))

    return rows.select(
        F.lit(directory).alias("dataset_dir"),
        F.lit(manifest["dataset_name"] or directory.rsplit("/", 1)[-1]).alias("dataset"),
        "*",
        inside(F.col("rtl_graph")).alias("rtl_path"),
        inside(F.col("asm_graph")).alias("asm_path"),
    )


def read_all_samples(spark: SparkSession, directories: str | Iterable[str] | None) -> DataFrame:
    """Samples of all directories under each other, checked as by :func:`read_samples`, in one job for all of them."""
    listed, rows, facts = _unchecked(spark, directories)
    _check(listed, rows.agg(*facts).first().asDict())
    return rows


def read_samples_observed(spark: SparkSession, directories: str | Iterable[str] | None) -> tuple[DataFrame, Callable[[], None]]:
    """The samples, and the check of what was read of them: no job of its own.

    The counts are metrics of the plan that reads the rows; the check waits for
    the first action over all of them and raises what :func:`read_samples`
    would have.
    """
    listed, rows, facts = _unchecked(spark, directories)
    seen = Observation()
    return rows.observe(seen, *facts), lambda: _check(listed, seen.get)


def _unchecked(spark: SparkSession, directories: str | Iterable[str] | None) -> tuple[list[dict], DataFrame, list[Column]]:
    """Manifests, samples of all directories, and what to count of them by directory."""
    dirs = dataset_dirs(directories)
    if not dirs:
        raise DatasetError("no dataset directory is given")
    all_ = [spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(f"{x}/manifest.json").withColumn("dir_", F.lit(k)) for k, x in enumerate(dirs)]
    held = {r["dir_"]: r.asDict() for r in reduce(DataFrame.unionByName, all_).collect()}  # a row for each directory
    rows, facts, listed = [], [], []
    for k, x in enumerate(dirs):
        if k not in held:
            raise DatasetError(f"{x}: no manifest")
        manifest = held[k] | {"directory": x}
        if manifest["schema_version"] != schemas.DATASET_VERSION:
            raise DatasetError(f"{x}: unsupported manifest version {manifest['schema_version']}")
        lines = spark.read.text(f"{x}/{manifest['samples'] or 'samples.jsonlines'}").where(F.trim("value") != "")
        made = lines.select(F.from_json("value", schemas.SAMPLE).alias("s")).select("s.*")
        rows.append(_located(made, x, manifest))
        own = F.col("dataset_dir") == x
        wrong = ~F.coalesce(F.col("schema_version") == schemas.SAMPLE_VERSION, F.lit(False))
        lacking = F.col("sample_id").isNull() | F.col("rtl_graph").isNull()
        facts += [F.count_if(own).alias(f"n{k}"), F.count_if(own & wrong).alias(f"versions{k}"), F.count_if(own & lacking).alias(f"missing{k}")]
        listed.append(manifest)
    return listed, reduce(DataFrame.unionByName, rows), facts


def _check(listed: list[dict], facts: dict[str, int]) -> None:
    for k, manifest in enumerate(listed):
        x, n = manifest["directory"], facts[f"n{k}"]
        if facts[f"versions{k}"]:
            raise DatasetError(f"{x}: {facts[f'versions{k}']} samples of another version")
        if facts[f"missing{k}"]:
            raise DatasetError(f"{x}: {facts[f'missing{k}']} samples without an id or an RTL graph")
        if manifest["total"] is not None and manifest["total"] != n:
            raise DatasetError(f"{x}: the manifest counts {manifest['total']} samples, there are {n}")


def graph_key(path: Column) -> Column:
    """Key of a graph file."""
    return sha_prefix(path, 16)


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def read_graphs(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Whole-file JSON graphs as (graph, path, fields...), and those that can't be parsed as (path, raw).

    A file that is not JSON as it stands is tried again with its control
    characters replaced by spaces and unescaped ones allowed.
    """
    return _parsed(_texts(spark, paths), schema)


def _texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select(_plain(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("raw"))


def _parsed(files: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    strict = F.from_json("raw", schema, {"mode": "PERMISSIVE"})
    lenient = F.from_json(without_controls(F.col("raw")), schema, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"})
    parsed = files.withColumn("g", F.when(_usable(strict), strict).otherwise(lenient))
    good = parsed.where(_usable(F.col("g"))).select(graph_key(F.col("path")).alias("graph"), "path", "g.*")
    return good, parsed.where(~_usable(F.col("g"))).select("path", "raw")


def _usable(g: Column) -> Column:
    return g.isNotNull() & g["nodes"].isNotNull() & g["edges"].isNotNull()


def read_sample_graphs(samples: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Graphs that ``samples`` name in a path column, each once; results as of :func:`read_graphs`.

    Only the folders come to the driver, as many as datasets have; which of
    their files are read is a semi join with the paths.  A dataset keeps other
    files elsewhere or loses the time to read them, not the result.
    """
    paths = samples.where(F.col(column).isNotNull()).select(_plain(F.col(column)).alias("path")).distinct()
    folders = [r[0] for r in paths.select(F.regexp_replace("path", r"/[^/]*$", "")).distinct().collect()]
    if not folders:
        empty = samples.sparkSession.createDataFrame([], "path string, raw string")
        return _parsed(empty, schema)
    return _parsed(_texts(samples.sparkSession, folders).join(paths, "path", "left_semi"), schema)


def join_graphs(samples: DataFrame, rtl: DataFrame, asm: DataFrame | None = None) -> DataFrame:
    """Samples with the key of their RTL graph and, where there is one, of their ASM graph."""
    keyed = _by_path(samples, "rtl_path", rtl, "rtl_key", "inner")
    if asm is None:
        return keyed.withColumn("asm_key", F.lit(None).cast("string"))
    return _by_path(keyed, "asm_path", asm, "asm_key", "left")


def _by_path(samples: DataFrame, column: str, graphs: DataFrame, key: str, how: str) -> DataFrame:
    files = graphs.select(F.col("path").alias("path_"), F.col("graph").alias(key))
    return samples.join(files, _plain(F.col(column)) == F.col("path_"), how).drop("path_")
