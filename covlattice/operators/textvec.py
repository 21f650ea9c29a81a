"""Vectors of texts from sparse n-gram features and a seeded orthogonal projection.

A text's features are its words and the character n-grams within them, hashed
into ``BUCKETS`` signed counts, damped by a square root.  They are projected by
a matrix with orthonormal columns that a seed and the sizes decide, so every
task makes the same one, and scaled to length one.  Texts are taken in chunks of
a few megabytes of features; a chunk that memory does not hold is halved and
tried again, down to one text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of features, length of the character n-grams, and texts of a chunk at most.
BUCKETS, GRAM, CHUNK = 4096, 3, 512
_WORD = re.compile(r"\w+")
_MATRICES: dict[tuple[int, int], np.ndarray] = {}


def projection(dims: int, seed: int = 0, buckets: int = BUCKETS) -> np.ndarray:
    """Orthonormal columns (buckets by dims), the same wherever they are made."""
    if not 0 < dims <= buckets:
        raise ValueError("there must be at least as many buckets as dimensions")
    if (dims, seed) not in _MATRICES:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, dims)))
        _MATRICES[dims, seed] = q * np.sign(np.diag(r))
    return _MATRICES[dims, seed]


def features(text: str | None) -> Counter[int]:
    """Signed counts by bucket: of words, and of the n-grams of words with their ends marked."""
    found: Counter[int] = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        marked = f"<{word}>"
        for token in [f"w:{word}", *(f"g:{marked[k : k + GRAM]}" for k in range(max(1, len(marked) - GRAM + 1)))]:
            h = zlib.crc32(token.encode())
            found[h % BUCKETS] += n if h >> 31 else -n
    return found


def encode_texts(texts: list[str | None], dims: int, seed: int = 0, chunk: int = CHUNK) -> np.ndarray:
    """A unit vector for each text; zeros for one without words."""
    matrix, out, at = projection(dims, seed), np.zeros((len(texts), dims)), 0
    while at < len(texts):
        try:
            part = texts[at : at + chunk]
            counts = np.zeros((len(part), BUCKETS))
            for row, text in zip(counts, part):
                for k, n in features(text).items():
                    row[k] = n
            made = (np.sign(counts) * np.sqrt(np.abs(counts))) @ matrix
        except MemoryError:
            if chunk == 1:
                raise
            chunk //= 2
            continue
        length = np.linalg.norm(made, axis=1, keepdims=True)
        out[at : at + len(part)] = np.divide(made, length, out=np.zeros(made.shape), where=length > 0)
        at += len(part)
    return out


def text_vectors(rows: DataFrame, dims: int, text: str = "text", out: str = "vector", seed: int = 0) -> DataFrame:
    """``rows`` with ``out``: the vectors of their texts; a null text has no words."""
    kept = [c for c in rows.columns if c != out]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = encode_texts(batch.column(text).to_pylist(), dims, seed)
            ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * dims)
            vectors = pa.ListArray.from_arrays(ends, pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), vectors], names=[*kept, out])

    return rows.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, f"{kinds}, `{out}` array<double>")
