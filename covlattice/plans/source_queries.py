"""Registered queries of the sources: dataset folders are written from the tables and read back.

Two folders, ``even`` and ``odd``, hold the customers of even and odd nations
as samples.  A nation is an RTL graph of its suppliers in a chain, a region an
ASM graph of its nations.  Module 7 has a file that is no JSON, module 3 one
with a raw control character.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covlattice.functions.text import cache_fingerprint
from covlattice.functions.vocab import TARGET_ORDER
from covlattice.operators import coverage, graph, pairs, ringpairs, samples
from covlattice.plans import adapters as view
from covlattice.session import shared_path, written_once
from covlattice.sources import cache, datasets, schemas, sinks, store
from covlattice.streaming import ingest, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_WRITTEN: dict[tuple[str, str, str], list[str]] = {}
_TABLES = ["nation", "supplier", "customer"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (at % len(values)).cast("int"))


def _rtl_files(s: SparkSession, d: str) -> DataFrame:
    """(graph, value): one JSON line for each nation; the last edge of a chain leads to no node."""
    key = F.col("s_suppkey")
    name = F.concat(F.lit("u"), key)
    chain = W.partitionBy("s_nationkey").orderBy("s_suppkey")  # suppliers of a nation: a file of their own anyway
    node = F.struct(name.alias("id"), _pick(["$add", "$dff", "input", "$mux", "odd"], key).alias("cell_type"), (key % 4 + 1).cast("int").alias("width"))
    edge = F.struct(
        (F.row_number().over(chain) - 1).alias("edge_id"), name.alias("source"), F.coalesce(F.lead(name).over(chain), F.lit("gone")).alias("target"),
        _pick(["DATA", "CONTROL", "ENABLE", "other"], key).alias("type"),
    )
    parts = view.table(s, d, "supplier").select("s_nationkey", node.alias("node"), edge.alias("edge")).groupBy("s_nationkey").agg(
        F.array_sort(F.collect_list("node")).alias("nodes"), F.array_sort(F.collect_list("edge")).alias("edges")
    )
    nations = view.table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey")).join(parts, "s_nationkey", "left")
    none = "array<struct<id: string>>"
    nodes, edges = (F.coalesce(F.to_json(c), F.to_json(F.array().cast(none))) for c in ("nodes", "edges"))
    module = F.when(F.col("s_nationkey") == 3, "m\x013").otherwise(F.concat(F.lit("m"), "s_nationkey"))
    line = F.concat(F.lit('{"module_name":"'), module, F.lit('","nodes":'), nodes, F.lit(',"edges":'), edges, F.lit("}"))
    return nations.select(F.col("s_nationkey").alias("graph"), F.when(F.col("s_nationkey") == 7, "{ not json").otherwise(line).alias("value"))


def _asm_files(s: SparkSession, d: str) -> DataFrame:
    """(graph, value): one JSON line for each region, and region 9 without blocks."""
    key = F.col("n_nationkey")
    name = F.concat(F.lit("b"), key)
    chain = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    one = F.struct(F.lit("add").alias("mnemonic"), F.array(F.lit("x1"), F.concat(F.lit("x"), key)).alias("operands"))
    code = F.when(key % 2 == 0, F.array(one, one)).otherwise(F.array().cast("array<struct<mnemonic: string, operands: array<string>>>"))
    node = F.struct(name.alias("id"), _pick(["BRANCH", "CALL", "strange"], key).alias("node_type"), code.alias("instructions"))
    edge = F.struct(name.alias("source"), F.coalesce(F.lead(name).over(chain), F.lit("gone")).alias("target"), F.lit("JUMP").alias("edge_type"))
    made = view.table(s, d, "nation").select("n_regionkey", name.alias("name"), node.alias("node"), edge.alias("edge")).groupBy("n_regionkey").agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("name", "node"))).alias("nodes"), F.collect_list("edge").alias("edges"))).alias("value")
    )
    empty = s.range(1).select(F.lit(9).alias("graph"), F.lit('{"nodes":{},"edges":[]}').alias("value"))
    return made.select(F.col("n_regionkey").alias("graph"), "value").unionByName(empty)


def _sample_lines(s: SparkSession, d: str, rtl: DataFrame, asm: DataFrame) -> DataFrame:
    """(parity, value): customers as sample lines; a third have no ASM graph, a fifth no label of their own."""
    c, key = view.table(s, d, "customer"), F.col("c_custkey")
    region = view.table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    met = c.join(F.broadcast(region), "c_nationkey").join(F.broadcast(rtl.select(F.col("graph").alias("c_nationkey"), F.col("file").alias("rtl"))), "c_nationkey")
    met = met.join(F.broadcast(asm.select(F.col("graph").alias("region"), F.col("file").alias("asm"))), "region")  # a row for each region
    label = lambda at, v: F.struct(at.cast("int").alias("edge_id"), F.lit(v).alias("label"))
    labels = F.when(key % 5 != 0, F.array(label(F.lit(0), 0), label(key % 4, 1), label(F.lit(1), 0), label(F.lit(100000), 1)))
    targets = F.struct(
        F.struct(F.when(key % 2 == 0, 0).alias("default"), labels.alias("labels")).alias("edge_coverage"),
        F.struct(F.create_map(F.lit("line"), (key % 101).cast("double"), F.lit("fsm"), F.lit(50.0)).alias("values")).alias("graph_coverage"),
    )
    line = F.struct(
        F.lit(schemas.SAMPLE_VERSION).alias("schema_version"), key.cast("string").alias("sample_id"), F.col("c_mktsegment").alias("test_id"),
        F.concat(F.lit("m"), "c_nationkey").alias("module_name"), F.col("rtl").alias("rtl_graph"), F.when(key % 3 != 0, F.col("asm")).alias("asm_graph"), targets.alias("targets"),
    )
    return met.select((F.col("c_nationkey") % 2).alias("parity"), F.to_json(line).alias("value"))


def dataset_folders(s: SparkSession, d: str) -> list[str]:
    """The two dataset folders of the tables in ``d``, written once in a session as long as their files stay as they are."""
    m = F.col("_metadata")
    files = [view.table(s, d, t).select(m["file_name"], m["file_size"], m["file_modification_time"].cast("string")).distinct() for t in _TABLES]
    state = reduce(DataFrame.unionByName, [f.toDF("name", "size", "time") for f in files])
    digest = state.agg(F.sum(F.xxhash64("name", "size", "time").cast("decimal(20,0)"))).first()[0]  # one number
    known = (s.sparkContext.applicationId, d, str(digest))
    if known in _WRITTEN and all(sinks.exists(s, f) for f in _WRITTEN[known]):
        return _WRITTEN[known]
    root = shared_path(s, "datasets")
    found = {}
    for kind, files in (("rtl", _rtl_files(s, d)), ("asm", _asm_files(s, d))):
        files.repartition("graph").write.partitionBy("graph").text(f"{root}/{kind}")
        listed = s.read.format("binaryFile").load(f"{root}/{kind}")
        found[kind] = listed.select("graph", F.concat(F.lit(f"{root}/"), F.regexp_extract("path", f"({kind}/graph=[^/]*/[^/]*)$", 1)).alias("file"))
    lines = _sample_lines(s, d, found["rtl"], found["asm"])
    folders = []
    for parity, name in enumerate(("even", "odd")):
        own = lines.where(F.col("parity") == parity).select("value")
        own.write.text(f"{root}/{name}/samples.jsonlines")
        manifest = F.struct(F.lit(schemas.DATASET_VERSION).alias("schema_version"), F.lit(name).alias("dataset_name"), F.lit(own.count()).alias("total"))
        s.range(1).select(F.to_json(manifest)).write.text(f"{root}/{name}/manifest.json")
        folders.append(f"{root}/{name}")
    _WRITTEN[known] = folders
    return folders


def _samples(s: SparkSession, d: str) -> DataFrame:
    return datasets.read_all_samples(s, dataset_folders(s, d))


def _joined(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Samples with the keys of their graphs, and the edges of those graphs."""
    rows = _samples(s, d)
    rtl, _ = datasets.read_sample_graphs(rows, "rtl_path", schemas.RTL_GRAPH)
    asm, _ = datasets.read_sample_graphs(rows, "asm_path", schemas.ASM_GRAPH)
    return datasets.join_graphs(rows, rtl, asm), graph.rtl_edges(rtl)


@query
def dataset_samples(s: SparkSession, d: str) -> DataFrame:
    """Samples of both folders by manifest, with their targets as they stand in the lines."""
    return _samples(s, d).select(
        "dataset", "sample_id", "test_id", "module_name", F.col("asm_path").isNotNull().alias("has_asm"),
        F.coalesce(F.size("targets.edge_coverage.labels"), F.lit(0)).alias("n_labels"), F.col("targets.graph_coverage.values")["line"].alias("line"),
    )


@query
def streamed_samples(s: SparkSession, d: str) -> DataFrame:
    """The same lines as a stream of files, kept until the input is used up."""
    found = []
    for folder in dataset_folders(s, d):
        out = shared_path(s, "streamed")  # a sink keeps a log of its batches, so each stream has its own
        rows = ingest.stream_samples(s, f"{folder}/samples.jsonlines").select("sample_id", "test_id", "module_name")
        ingest.write_stream(rows, f"{out}/rows", f"{out}/progress").awaitTermination()
        found.append(s.read.schema(rows.schema).parquet(f"{out}/rows"))
    return found[0].unionByName(found[1])


@query
def rtl_graph_tables(s: SparkSession, d: str) -> DataFrame:
    """Sizes and codes of the RTL graphs that samples name; a file that needs the lenient reader counts like any other."""
    rtl, _ = datasets.read_sample_graphs(_samples(s, d), "rtl_path", schemas.RTL_GRAPH)
    names = rtl.select("graph", F.regexp_replace("module_name", " ", "").alias("module"))
    n = graph.rtl_nodes(rtl).groupBy("graph").agg(
        F.count("*").alias("n_nodes"), F.sum("cell").alias("cells"), F.sum("node_type").alias("node_types"), F.sum("width").alias("widths")
    )
    e = graph.rtl_edges(rtl).groupBy("graph").agg(F.count("*").alias("n_edges"), F.count_if("valid").alias("n_valid"), F.sum("edge_type").alias("edge_types"))
    met = names.join(n, "graph", "left").join(e, "graph", "left")
    return met.drop("graph").na.fill(0)


@query
def broken_graphs(s: SparkSession, d: str) -> DataFrame:
    """Files that neither reader can parse."""
    _, bad = datasets.read_sample_graphs(_samples(s, d), "rtl_path", schemas.RTL_GRAPH)
    return bad.select(F.regexp_extract("path", "graph=([0-9]+)/", 1).cast("int").alias("module"))


@query
def asm_graph_tables(s: SparkSession, d: str) -> DataFrame:
    """Blocks of every ASM file, with their edges to known blocks; a graph without blocks has one."""
    root = dataset_folders(s, d)[0].rsplit("/", 1)[0]
    folders = [f"{root}/asm/graph={k}" for k in (0, 1, 2, 3, 4, 9)]
    asm, _ = datasets.read_graphs(s, folders, schemas.ASM_GRAPH)
    region = asm.select("graph", F.regexp_extract("path", "graph=([0-9]+)/", 1).cast("int").alias("region"))
    out = graph.asm_edges(asm).groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.max("edge_type").alias("edge_type"))
    met = graph.asm_nodes(asm).join(region, "graph").join(out, ["graph", "node"], "left")
    return met.select("region", "node", "node_type", "text", F.coalesce("n_out", F.lit(0)).alias("n_out"), "edge_type")


@query
def sample_graphs(s: SparkSession, d: str) -> DataFrame:
    """Samples joined to their graphs; those of a broken RTL file drop out, a missing ASM graph is null."""
    rows, _ = _joined(s, d)
    return rows.select("dataset", "sample_id", F.col("asm_key").isNotNull().alias("has_asm"), F.length("rtl_key").alias("key_length"))


@query
def sample_table(s: SparkSession, d: str) -> DataFrame:
    """Training side of the samples (three segments) with labels and targets."""
    rows, edges = _joined(s, d)
    split = rows.select("test_id").distinct().select("test_id", F.col("test_id").isin("BUILDING", "MACHINERY").alias("is_val"))
    made = samples.sample_table(samples.restrict(rows, split, validation=False), edges)
    at = {c: F.round(F.get("y", F.lit(k)), 6).alias(c) for k, c in enumerate(TARGET_ORDER)}
    shown = F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["position"].cast("string"), x["label"].cast("string"))), ",")
    return made.select("sample_id", "test_id", "module_name", "n_edges", "default_label", shown.alias("labels"), at["line"], at["fsm"], at["toggle"])


@query
def cached_encodings(s: SparkSession, d: str) -> DataFrame:
    """Texts encoded in two calls; the second encodes only what the cache lacks (round says in which call)."""
    texts = view.table(s, d, "conversations").select("turn", "text").where("text is not null")
    path, fingerprint = shared_path(s, "encodings"), cache_fingerprint("lengths", 512, "mean")

    def encode(mark: float) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: rows.select("content_key", F.array(F.length("text").cast("double"), F.lit(mark)).alias("vector"))

    sinks.cached_encodings(texts.where("turn % 2 = 0").select("text"), path, fingerprint, encode(1.0))
    made = sinks.cached_encodings(texts.select("text"), path, fingerprint, encode(2.0))
    return made.select("content_key", F.get("vector", F.lit(0)).alias("length"), F.get("vector", F.lit(1)).alias("round"))


@query
def healed_encodings(s: SparkSession, d: str) -> DataFrame:
    """A cache of which every seventh entry is spoilt, read again: good entries stay, spoilt and missing ones are encoded anew.

    ``round`` says in which call a text was encoded; ``reason`` why its first entry was put aside.
    """
    texts = view.table(s, d, "conversations").select("turn", "text").where("text is not null")
    folder, fingerprint = shared_path(s, "healing"), cache_fingerprint("lengths", 512, "mean")

    def encode(mark: float) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: rows.select("content_key", F.array(F.length("text").cast("double"), F.lit(mark)).alias("vector"))

    first = cache.encode_through(texts.where("turn % 2 = 0"), f"{folder}/made", fingerprint, 2, encode(1.0))
    n = F.get("vector", F.lit(0))
    vector = F.when(n % 7 == 1, F.slice("vector", 1, 1)).when(n % 7 == 2, F.array(F.lit(float("nan")), n)).otherwise(F.col("vector"))
    held = first.select("content_key", F.when(n % 7 == 3, F.array(n + 1, F.lit(1.0))).otherwise(vector).alias("vector"), cache.checksum(F.col("vector")).alias("checksum"))
    cache.add_part(held, f"{folder}/spoilt")
    made = cache.encode_through(texts, f"{folder}/spoilt", fingerprint, 2, encode(2.0))
    why = cache.quarantined(s, f"{folder}/spoilt").select("content_key", "reason")
    return made.join(why, "content_key", "left").select("content_key", n.alias("length"), F.get("vector", F.lit(1)).alias("round"), "reason")


@query
def stored_samples(s: SparkSession, d: str) -> DataFrame:
    """Customers of building firms, read by key from a sorted store of all customers, and their orders from another."""
    folder = shared_path(s, "store")
    customer = view.table(s, d, "customer")
    store.write_keyed(customer, f"{folder}/customer", "c_custkey")
    store.write_keyed(view.table(s, d, "orders"), f"{folder}/orders", "o_custkey")
    asked = customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    found = store.read_many(s, f"{folder}/customer", "c_custkey", asked)
    theirs = store.read_many(s, f"{folder}/orders", "o_custkey", asked.withColumnRenamed("c_custkey", "o_custkey"))
    n = theirs.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return found.join(n, "c_custkey", "left").select("c_custkey", "c_nationkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query
def metric_history(s: SparkSession, d: str) -> DataFrame:
    """A history with an epoch written twice: the later step counts."""
    path = shared_path(s, "history")
    segments = view.table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("name"))
    for epoch, step, scale in ((0, 10, 1.0), (1, 20, 2.0), (1, 30, 4.0)):
        rows = segments.agg((F.count("*") * scale).cast("string").alias("value")).select(F.lit("val").alias("stage"), "name", "value")
        sinks.append_metrics(rows, path, epoch, step)
    return sinks.latest_metrics(s.read.parquet(path))


@query
def streamed_runs(s: SparkSession, d: str) -> DataFrame:
    """Metrics and early stopping of runs on a stream that is started twice: epochs 0 to 9, then the rest, from the kept state."""
    o = view.table(s, d, "orders").select(
        F.col("o_orderpriority").alias("run"), (F.col("o_orderkey") % 20).cast("int").alias("epoch"),
        (F.col("o_totalprice") / 100000 * (1 + (F.col("o_custkey") % 7 - 3) / (10 + F.col("o_orderkey") % 20))).alias("pred"),
        (F.col("o_totalprice") / 100000).alias("target"),
    )
    folder = shared_path(s, "runs")
    for part in (o.where("epoch < 10"), o.where("epoch >= 10")):
        part.write.mode("append").parquet(f"{folder}/rows")
        stream = s.readStream.schema(o.schema).parquet(f"{folder}/rows")
        runs.write_reports(runs.run_reports(stream, patience=2), f"{folder}/reports", f"{folder}/state").awaitTermination()
    made = s.read.schema(runs.REPORT).parquet(f"{folder}/reports")
    return made.select("run", "epoch", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mse", "mae", "r2", "best")], "bad", "stop_epoch")


@query
def epoch_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs chosen anew for each of two epochs, by seed."""
    sigs, found = written_once(coverage.signatures(view.coverage(s, d)), "signatures"), []
    for epoch in range(2):
        seed = str(epoch)
        chosen = ringpairs.select_pairs(ringpairs.ranked_candidates(sigs, seed), seed)
        found.append(chosen.select(F.lit(epoch).alias("epoch"), "module", "sample_a", "sample_b", "anchor", "stratum"))
    return found[0].unionByName(found[1])

