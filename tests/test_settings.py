import json

import pytest

from covlattice.plans import config
from covlattice.sources import datasets, schemas


def test_artifacts_are_upgraded_and_compared(spark, tmp_path):
    now = config.to_artifact(config.Config())
    old = {"version": 1, "model": {k: v for k, v in now["model"].items() if k != "architecture"}, "text_encoder": now["text_encoder"]}
    assert config.from_artifact(old) == config.from_artifact(now) == config.Config() and config.differences(old, now) == {}
    config.require_same(old, now)
    other = now | {"model": now["model"] | {"layers": 5, "architecture": "gcn"}}
    with pytest.raises(config.ConfigMismatch, match="model.architecture: 'fusion' and 'gcn'; model.layers: 4 and 5"):
        config.require_same(now, other)
    for broken in (now | {"version": 3}, old | {"model": now["model"]}, now | {"model": now["model"] | {"more": 1}}, now | {"model": {"layers": 4}}):
        with pytest.raises(config.ConfigMismatch):
            config.require_same(now, broken)
    with pytest.raises(ValueError, match="architecture"):
        config.ModelConfig(architecture="other")
    for artifact in (now, other):
        config.save_artifact(spark, f"{tmp_path}/model.json", artifact)
        assert config.load_artifact(spark, f"{tmp_path}/model.json") == artifact


def folder(path, total, rows):
    path.mkdir()
    (path / "manifest.json").write_text(json.dumps({"schema_version": schemas.DATASET_VERSION, "dataset_name": path.name, "samples": "s.jsonlines", "total": total}))
    (path / "s.jsonlines").write_text("\n\n".join(json.dumps(r) for r in rows))
    return str(path)


def row(k, **more):
    return {"schema_version": schemas.SAMPLE_VERSION, "sample_id": f"s{k}", "rtl_graph": "g.json", "module_name": "m"} | more


def test_observed_samples_are_checked_by_the_plan_that_reads_them(spark, tmp_path):
    good = folder(tmp_path / "good", 2, [row(1), row(2)])
    rows, check = datasets.read_samples_observed(spark, [good, folder(tmp_path / "also", None, [row(3)])])
    assert sorted((r.dataset, r.sample_id) for r in rows.collect()) == [("also", "s3"), ("good", "s1"), ("good", "s2")]
    check()
    cases = [(3, [row(1)], "counts 3 samples, there are 1"), (1, [row(1, schema_version="x")], "another version"), (1, [row(1, rtl_graph=None)], "without an id")]
    for k, (total, lines, why) in enumerate(cases):
        bad = folder(tmp_path / f"bad{k}", total, lines)
        rows, check = datasets.read_samples_observed(spark, [good, bad])
        assert rows.count() == 3
        with pytest.raises(datasets.DatasetError, match=why):
            check()
        with pytest.raises(datasets.DatasetError, match=why):
            datasets.read_all_samples(spark, [good, bad])
    with pytest.raises(datasets.DatasetError, match="no dataset"):
        datasets.read_all_samples(spark, None)
