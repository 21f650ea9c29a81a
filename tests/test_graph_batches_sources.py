import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from covlattice.functions import vocab
from covlattice.functions.text import stable_seed
from covlattice.operators import batching, fusion, graph, order, splits, stats
from covlattice.plans import config
from covlattice.sources import datasets, schemas, sinks
from covlattice.streaming import ingest


def rtl(cells, edges):
    return {
        "schema_version": "g", "module_name": "m",
        "nodes": [{"id": f"n{i}", "cell_type": c, "width": 8} for i, c in enumerate(cells)],
        "edges": [{"edge_id": i, "source": s, "target": t, "type": k} for i, (s, t, k) in enumerate(edges)],
    }


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    (root / "rtl.json").write_text(json.dumps(rtl(["input", "$add", "odd"], [("gone", "n1", "DATA"), ("n0", "n1", "CONTROL"), ("n1", "n2", "what")])))
    (root / "bad.json").write_text("{ not json")
    asm = {"nodes": {"b": {"id": "b", "node_type": "BRANCH", "instructions": [{"mnemonic": "add", "operands": ["x1", "x2"]}, {"mnemonic": "ret", "operands": []}]},
                     "a": {"id": "a", "node_type": "strange", "instructions": []}}, "edges": [{"source": "b", "target": "a", "edge_type": "JUMP"}, {"source": "b", "target": "zz", "edge_type": "JUMP"}]}
    (root / "asm.json").write_text(json.dumps(asm).replace("x1", "x\x011"))
    sample = {"schema_version": "sample.v1", "sample_id": "s1", "test_id": "t", "module_name": "m", "rtl_graph": "rtl.json", "asm_graph": "asm.json",
              "targets": {"edge_coverage": {"default": -1, "labels": [{"edge_id": 1, "label": 0}, {"edge_id": 1, "label": 1}, {"edge_id": 0, "label": 0}, {"edge_id": 99, "label": 1}]},
                          "graph_coverage": {"values": {"branch": 50.0, "line": None, "fsm": 0.0, "toggle": 100.0}}}}
    other = {"schema_version": "sample.v1", "sample_id": "s2", "test_id": "t", "module_name": "m", "rtl_graph": "rtl.json"}
    (root / "samples.jsonlines").write_text(json.dumps(sample) + "\n\n" + json.dumps(other) + "\n")
    (root / "manifest.json").write_text(json.dumps({"schema_version": "dataset.v1", "dataset_name": "d", "total": 2}))
    return root


def test_samples(spark, dataset):
    rows = datasets.read_all_samples(spark, [f"{dataset}/"]).orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == ["s1", "s2"] and rows[0].rtl_path == f"{dataset}/rtl.json" and rows[1].asm_path is None
    assert datasets.dataset_dirs(None) == [] and datasets.dataset_dirs("a/") == ["a"]


@pytest.mark.parametrize("change", [{"total": 1}, {"schema_version": "dataset.v0"}])
def test_bad_manifest(spark, dataset, tmp_path, change):
    (tmp_path / "samples.jsonlines").write_text((dataset / "samples.jsonlines").read_text())
    (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": "dataset.v1", "total": 2} | change))
    with pytest.raises(datasets.DatasetError):
        datasets.read_samples(spark, str(tmp_path))


def test_rtl_graph_and_labels(spark, dataset):
    good, bad = datasets.read_graphs(spark, [f"{dataset}/rtl.json", f"{dataset}/bad.json"], schemas.RTL_GRAPH)
    assert [r.path for r in bad.collect()] == [f"{dataset}/bad.json"]
    nodes = graph.rtl_nodes(good).orderBy("position").collect()
    assert [(r.cell, r.node_type) for r in nodes] == [(0, 0), (32, 7), (73, 11)]
    edges = graph.rtl_edges(good)
    assert [(r.valid, r.edge_type) for r in edges.orderBy("position").collect()] == [(False, 0), (True, 3), (True, 0)]
    samples = datasets.join_graphs(datasets.read_samples(spark, str(dataset)), good)
    keyed = samples.select(F.col("sample_id").alias("sample"), F.col("rtl_key").alias("graph"), F.col("targets.edge_coverage.default").alias("default_label"),
                           F.col("targets.edge_coverage.labels").alias("labels"), F.col("targets.graph_coverage.values").alias("values"))
    made = graph.dense_edge_labels(edges, keyed, graph.long_labels(keyed)).orderBy("sample", "position").collect()
    assert [(r["sample"], r.position, r.label) for r in made] == [("s1", 1, 1), ("s1", 2, -1), ("s2", 1, -1), ("s2", 2, -1)]
    y = {r["sample"]: r.y for r in graph.graph_targets(keyed, vocab.TARGET_ORDER).collect()}
    assert y == {"s1": [0.5, None, 0.0, 1.0, None], "s2": [None] * 5}


def test_asm_graph(spark, dataset):
    good, bad = datasets.read_graphs(spark, [f"{dataset}/asm.json"], schemas.ASM_GRAPH)
    assert bad.count() == 0
    nodes = graph.asm_nodes(good).orderBy("position").collect()
    assert [(r.node, r.node_type, r.text) for r in nodes] == [("b", 3, "add x 1, x2\nret"), ("a", 18, "nop")]
    assert [(r.src, r.dst, r.edge_type) for r in graph.asm_edges(good).collect()] == [("b", "a", 3)]
    none = spark.createDataFrame([("g", None, [], {}, [])], "graph string, " + schemas.ASM_GRAPH)
    assert [(r.node_type, r.text) for r in graph.asm_nodes(none).collect()] == [(0, "nop")]


def test_vocabularies(spark):
    assert len(vocab.CELL_TYPES) == 74 and vocab.AGG_GROUPS == [0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    row = spark.range(1).select(vocab.coverage_index(F.lit("fsm")).alias("i"), stable_seed(F.lit("42"), F.lit("a")).alias("s")).first()
    import hashlib

    assert row.i == 2 and int(row.s) == int.from_bytes(hashlib.sha256(b"42\x00a").digest()[:8], "big")
    with pytest.raises(Exception, match="unknown coverage type"):
        spark.range(1).select(vocab.coverage_index(F.lit("nope"))).collect()


def test_message_passing(spark):
    m = spark.createDataFrame([("g", "a", 0, 0, -2.0, 0.5), ("g", "a", 5, 1, -1.0, 0.5), ("g", "b", 3, 0, 4.0, 1.0), ("g", "b", 1, 0, 2.0, 0.0)],
                              "graph string, dst string, edge_type int, target_port int, m double, attention double")
    stats_ = {r.dst: r for r in graph.segment_mean_max(m).collect()}
    assert (stats_["a"].all_max, stats_["a"].all_mean, stats_["a"].degree) == (0.0, -1.5, 2)
    nodes = spark.createDataFrame([("g", "a", 4), ("g", "b", 7), ("g", "c", 2)], "graph string, node string, node_type int")
    out = {r.node: r.out for r in graph.routed_aggregate(m, nodes).collect()}
    import math

    s = lambda x: 1 / (1 + math.exp(-x))
    assert out["a"] == pytest.approx(s(-1) * -1 + (1 - s(-1)) * (s(0) * -2.0))
    assert out["b"] == pytest.approx(s(4) * 2.0) and out["c"] == 0.0
    e = spark.createDataFrame([("g", "a", "b", 0.0), ("g", "c", "b", math.log(3))], "graph string, src string, dst string, score double")
    assert {r.src: round(r.attention, 6) for r in graph.attention_softmax(e).collect()} == {"a": 0.25, "c": 0.75}
    x = spark.createDataFrame([("g", k, [float(i), 1.0]) for i, k in enumerate("abc")], "graph string, node string, x array<double>")
    got = {r.node: r.x for r in graph.gcn_propagate(e, x).collect()}
    assert got["a"] == pytest.approx([0.0, 1.0]) and got["b"] == pytest.approx([0 + 1 / 3 + 2 / math.sqrt(3), 2 / math.sqrt(3) + 1 / 3])
    assert graph.mean_pool(x).first().x == pytest.approx([1.0, 1.0])
    latents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [100.0, 0.0])], "latent int, q array<double>")
    pooled = fusion.cross_pool(x, latents, 2)
    assert {r.latent: [round(v, 6) for v in r.x] for r in pooled.collect()} == {0: [1.0, 1.0], 1: [2.0, 1.0]}
    assert fusion.cross_read(x, pooled, 0.5, 2).count() == 3
    assert graph.combine_graphs(graph.mean_pool(x), graph.mean_pool(x), "add").first().x == pytest.approx([2.0, 2.0])


def test_graphs_that_samples_name(spark, dataset):
    samples = datasets.read_samples(spark, str(dataset))
    good, bad = datasets.read_sample_graphs(samples, "rtl_path", schemas.RTL_GRAPH)
    assert [r.path for r in good.collect()] == [f"{dataset}/rtl.json"] and bad.count() == 0
    assert datasets.read_sample_graphs(samples, "asm_path", schemas.ASM_GRAPH)[0].count() == 1
    none, _ = datasets.read_sample_graphs(samples.where("false"), "rtl_path", schemas.RTL_GRAPH)
    assert none.count() == 0 and none.columns == good.columns


def test_bucket_packing(spark):
    assert batching.packed(np.array([9, 9, 3]), 10).tolist() == [0, 1, 2]
    assert batching.packed(np.array([3, 3, 20, 1]), 10).tolist() == [0, 0, 1, 2]
    assert batching.packed(np.array([], dtype=int), 10).tolist() == []
    rows = spark.range(100).select(F.col("id").alias("sample"), (F.col("id") % 7).alias("size"))
    made = batching.bucket_batches(rows, budget=10, edges=(4,), rows_per_run=30)
    assert made.select("run").distinct().count() == 4 and made.count() == 100
    full = made.groupBy("bucket", "run", "batch").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]
    assert full <= 10
    assert batching.bucket_batches(rows.where("false")).count() == 0


def test_orders_over_whole_tables(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 < 3, 0.0).otherwise(F.col("id") / 7).alias("v"), F.col("id"))
    at = {r.id: r.position for r in order.positions(rows, ["v", "id"]).collect()}
    assert [k for k, _ in sorted(at.items(), key=lambda x: x[1])] == [r.id for r in rows.orderBy("v", "id").collect()] and max(at.values()) == 499
    got = {r.g: r.m for r in order.lower_medians(rows, "v", "m", ["g"]).collect()}
    assert got == {r.g: r.m for r in rows.groupBy("g").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("m")).collect()}
    assert order.lower_medians(rows.where("false"), "v", "m").first().m is None
    assert order.positions(rows.where("false"), ["v"]).count() == 0


def test_padded_and_evaluation_shards(spark):
    five = spark.range(5).select(F.col("id").alias("number"))
    made = batching.padded_shards(five, "number", 2).orderBy("number").collect()
    assert [r.rank_id for r in made] == [0, 1, 0, 1, 0, 1]
    rows = batching.eval_shards(spark.range(13).select(F.col("id").alias("position")), "position", ranks=2, batch_size=4).collect()
    assert len(rows) == 13 and {(r.rank_id, r.batch) for r in rows} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    with pytest.raises(ValueError):
        batching.eval_shards(spark.range(1).select(F.col("id").alias("position")), "position", ranks=2, batch_size=4)


def test_snake_batches_span_the_order(spark):
    rows = spark.range(24).select((F.col("id") / 24).alias("score"), F.md5(F.col("id").cast("string").cast("binary")).alias("tie"))
    made = batching.ranking_batches(rows, "score", "tie", 6).collect()
    for b in range(4):
        own = [r.position // 8 for r in made if r.batch == b]
        assert len(own) == 6 and set(own) == {0, 1, 2}


def test_split_keeps_stimuli_whole_and_modules_in_training(spark):
    rows = spark.range(600).select((F.col("id") % 97).alias("test_id"), (F.col("id") % 11).alias("module"))
    split = splits.grouped_split(rows)
    d = splits.split_diagnostics(rows, split).first()
    assert d.shared_stimuli == 0 and d.val_only_modules == 0 and 60 <= d.val_rows < 70 and d.train_rows + d.val_rows == 600
    lone = spark.createDataFrame([(1, 1), (2, 2)], "test_id int, module int")
    assert splits.grouped_split(lone).where("is_val").count() == 0
    with pytest.raises(ValueError):
        splits.grouped_split(rows.where("false"))


def test_statistics(spark):
    rows = spark.createDataFrame([("m", -1), ("m", 0), ("m", 1), ("n", 1)], "module string, label int")
    by = {r.module: r for r in stats.label_distribution(rows).collect()}
    assert (by[None].n, by["m"].ratio, by["n"].ratio) == (4, 1.0, None)
    assert {r.bucket: r.n for r in stats.histogram(spark.createDataFrame([(0.0,), (0.99,), (1.0,), (None,)], "v double"), "v", 0.0, 0.25, 4).collect()} == {0: 1, 3: 2}
    assert stats.correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first().r is None


def test_cache_and_history(spark, tmp_path):
    calls = []

    def encode(rows):
        calls.append(rows.count())
        return rows.select("content_key", F.array(F.length("text").cast("double")).alias("vector"))

    texts = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    assert sinks.cached_encodings(texts, str(tmp_path / "c"), "f", encode).count() == 2
    more = sinks.cached_encodings(texts.union(spark.createDataFrame([("ccc",)], "text string")), str(tmp_path / "c"), "f", encode)
    assert more.count() == 3 and calls == [2, 1]
    history = str(tmp_path / "h")
    for epoch, v in enumerate([5.0, 3.0, 4.0, 4.0, 1.0]):
        sinks.append_metrics(spark.createDataFrame([("val", "loss", str(v))], "stage string, name string, value string"), history, epoch, 10 * epoch)
    rows = spark.read.parquet(history)
    assert [r.epoch for r in sinks.best_checkpoints(rows, "loss", 2).collect()] == [4, 1]
    assert sinks.early_stop(rows, "loss", 2).first().stop_epoch == 3
    assert [r.rate for r in sinks.plateau_rates(rows, "loss", 1, 0.5).orderBy("epoch").collect()] == [1.0, 1.0, 1.0, 0.5, 0.5]
    assert sinks.plateau_rates(rows, "none", 1).count() == 0
    sinks.write_with_quarantine(spark.createDataFrame([(1, True), (2, None)], "v int, ok boolean"), "ok", str(tmp_path / "g"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).first().v == 2


def test_streams(spark, dataset, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonlines").write_text((dataset / "samples.jsonlines").read_text() + json.dumps({"schema_version": "other", "sample_id": "x"}) + "\n")
    rows = ingest.stream_samples(spark, str(tmp_path / "in"))
    ingest.write_stream(rows.select("sample_id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.sample_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["s1", "s2"]
    spark.createDataFrame([("t", "2024-01-01 00:00:00")] * 2, "text string, at string").selectExpr("text", "CAST(at AS timestamp) AS at").write.parquet(str(tmp_path / "texts"))
    stream = spark.readStream.schema("text string, at timestamp").parquet(str(tmp_path / "texts"))
    ingest.write_stream(ingest.new_texts(stream, "f"), str(tmp_path / "o2"), str(tmp_path / "cp2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 1


def test_settings():
    assert config.from_artifact(config.to_artifact(config.Config())) == config.Config()
    with pytest.raises(ValueError):
        config.SamplingConfig(pool=1)
    with pytest.raises(ValueError):
        config.from_artifact({"version": 1, "model": {}, "text_encoder": {}})
    assert config.TextEncoderConfig().fingerprint == "hashing|512|mean" and config.SamplingConfig().quotas == {"low": 2, "mid": 1, "high": 1}
