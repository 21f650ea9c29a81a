"""Settings as frozen dataclasses that check themselves."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import SparkSession

from covlattice.functions.text import cache_fingerprint


@dataclass(frozen=True)
class SamplingConfig:
    pool: int = 256
    low: int = 2
    mid: int = 1
    high: int = 1

    def __post_init__(self) -> None:
        if self.pool < 1 or min(self.low, self.mid, self.high) < 0:
            raise ValueError("the pool must be positive and no quota negative")
        if not 0 < self.low + self.mid + self.high <= self.pool:
            raise ValueError("the quotas must ask for something and fit into the pool")

    @property
    def quotas(self) -> dict[str, int]:
        return {"low": self.low, "mid": self.mid, "high": self.high}


#: Gated layers with cross fusion, gated layers whose graph vectors are added, convolution layers with cross fusion.
ARCHITECTURES = ("fusion", "pooled_add", "gcn")


@dataclass(frozen=True)
class ModelConfig:
    hidden_dim: int = 256
    layers: int = 4
    box_dim: int = 10
    latents: int = 16
    drop_path: float = 0.0
    architecture: str = "fusion"

    def __post_init__(self) -> None:
        if self.architecture not in ARCHITECTURES:
            raise ValueError(f"unknown architecture: {self.architecture}")
        if min(self.hidden_dim, self.layers, self.box_dim, self.latents) < 1 or not 0 <= self.drop_path < 1:
            raise ValueError("sizes must be positive and the drop rate below one")


@dataclass(frozen=True)
class TextEncoderConfig:
    model: str = "hashing"
    max_length: int = 512
    pooling: str = "mean"

    @property
    def fingerprint(self) -> str:
        return cache_fingerprint(self.model, self.max_length, self.pooling)


@dataclass(frozen=True)
class Config:
    model: ModelConfig = field(default_factory=ModelConfig)
    text_encoder: TextEncoderConfig = field(default_factory=TextEncoderConfig)


#: Version of the artifacts that are written; older ones are upgraded as they are read.
VERSION = 2


class ConfigMismatch(ValueError):
    """Two artifacts do not describe the same settings."""


def to_artifact(config: Config) -> dict:
    return {"version": VERSION} | asdict(config)


def upgraded(artifact: dict) -> dict:
    """The artifact in the present version: the first one had no architecture, which was that of the default."""
    if artifact.get("version") == 1:
        model = artifact.get("model", {})
        if "architecture" in model:
            raise ValueError("model: an artifact of version 1 has no architecture")
        return artifact | {"version": VERSION, "model": model | {"architecture": ModelConfig.architecture}}
    if artifact.get("version") != VERSION:
        raise ValueError(f"unknown artifact version: {artifact.get('version')}")
    return artifact


def from_artifact(artifact: dict) -> Config:
    """The settings of an artifact of this version or an older one; missing or unknown fields are an error."""
    artifact, parts = upgraded(artifact), {}
    for name, kind in (("model", ModelConfig), ("text_encoder", TextEncoderConfig)):
        given, known = artifact.get(name, {}), {f.name for f in fields(kind)}
        if set(given) != known:
            raise ValueError(f"{name}: missing {sorted(known - set(given))}, unknown {sorted(set(given) - known)}")
        parts[name] = kind(**given)
    return Config(**parts)


def differences(a: dict, b: dict) -> dict[str, tuple]:
    """Fields in which two artifacts differ, by name, once both are in the present version and checked."""
    x, y = (asdict(from_artifact(one)) for one in (a, b))
    return {f"{part}.{k}": (v, y[part][k]) for part, given in x.items() for k, v in given.items() if v != y[part][k]}


def require_same(a: dict, b: dict) -> None:
    """An error that names the fields in which the artifact of a model and that of its inputs differ."""
    try:
        found = differences(a, b)
    except ValueError as error:
        raise ConfigMismatch(str(error)) from error
    if found:
        raise ConfigMismatch("; ".join(f"{k}: {v!r} and {w!r}" for k, (v, w) in sorted(found.items())))


def save_artifact(spark: SparkSession, path: str, artifact: dict) -> None:
    """Write an artifact as a JSON file, in whatever file system ``path`` names; a reader sees the old one or the new."""
    jvm = spark.sparkContext._jvm
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    try:
        out.write(bytearray(json.dumps(artifact, indent=2).encode()))
    finally:
        out.close()
    fs.delete(old, False)
    if not fs.rename(new, old):
        raise OSError(f"{path} could not be written")


def load_artifact(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
