"""Encoding and decoding of whole texts with a word-end BPE vocabulary.

The encoding cuts texts at forced boundaries (:mod:`covlattice.llm.wordbpe`);
texts never leave their partition.

Defined results: a null text is the empty text, which has no ids and decodes to
the empty text; equal rows get equal results, one each; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _texts(docs: DataFrame, keys: dict[str, str], text: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(k) for k, c in keys.items()], F.col(f"`{text}`").alias("text_"))


def encode_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int) of every document."""
    from covlattice.llm.wordbpe import encoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(enc.ids(t.as_py()), np.int32) for t in batch.column("text_")]
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            values = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"]
            )

    chosen = _texts(docs, {"doc_id": doc_id}, text)
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and ``text``: what the library's decode gives for the ids, special tokens included."""
    from covlattice.llm.wordbpe import encoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = encoder(vocabulary).shown
        for batch in batches:
            texts = [" ".join([shown[i] for i in x or ()]) for x in batch.column("ids_").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts)], names=["doc_id", "text"])

    chosen = encoded.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids_"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, text string")


def encoding_digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256.

    Ids and decoded text of a document are put together from those of its
    runs, hashed and let go, so that a task holds one document's at a time.
    """
    from covlattice.llm.wordbpe import encoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for t in batch.column("text_"):
                shown, tokens = enc.strings(t.as_py())
                counts.append(shown.count(" ") + 1 if shown else 0)
                ids.append(hashlib.sha256(shown.encode()).hexdigest())
                decoded.append(hashlib.sha256(tokens.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = _texts(docs, {"doc_id": doc_id}, text)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
