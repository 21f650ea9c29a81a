"""Token-id files with a shared zstandard dictionary.

A data set is a folder with ``dictionary`` (one row: bytes, SHA-256, width of an
id) and ``segments``, both Parquet, so that Spark's writers commit them and any
store that Spark reaches can hold them.  A segment is about a megabyte: the
frames of consecutive documents one after the other, each compressed on its own
with the dictionary, and an index of ids, token counts and offsets.  A short
document is read by its segment's index and one frame; the dictionary's hash in
every segment is checked first.

Documents are dealt by ranges of their id, so the files hold them in ascending
order; an id that very many documents have is dealt by ranges of their frames'
checksums as well.  A part knows how many tokens came before each of its
segments, and the totals of the parts (as many as ranges) give the place of each
document among all ids.

Defined results: a null text is the empty text and holds the end id alone;
documents of equal ids stand together, in the order of the checksums of their
frames; null ids come first; an id that is no whole number (or a string of one)
is an error; an empty table gives a data set without segments; other columns
are not kept.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the dictionary, and the documents and bytes of ids that it is trained on at most.
DICTIONARY_BYTES = 64 * 1024
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 500, 4 << 20
#: Longer texts are not trained on.
SAMPLE_CHARS = 1 << 15
#: Bytes of frames in a segment, about.
SEGMENT_BYTES = 1 << 20
#: Rows that a range of ids is meant to hold, and ranges of different ids at most (larger ones from then on).
PART_ROWS, PARTS = 5_000, 16_384
LEVEL = 3


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for these serialised id arrays; a raw one where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def _serialised(encoder, text: str | None, end_id: int, width: int) -> np.ndarray:
    ids = np.frombuffer(encoder.ids(text), np.uint32)
    return np.append(ids, np.uint32(end_id)).astype(f"<u{width}")


def _sample(docs: DataFrame, vocabulary: str, end_id: int, width: int) -> list[bytes]:
    from covlattice.llm.wordbpe import encoder

    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    few = short.select("text").limit(SAMPLE_DOCUMENTS).collect()
    enc, out, size = encoder(vocabulary), [], 0
    for row in few:
        out.append(_serialised(enc, row["text"], end_id, width).tobytes())
        size += len(out[-1])
        if size > SAMPLE_BYTES:
            break
    return out


def part_bounds(docs: DataFrame) -> list[tuple[bool, int, int]]:
    """Where the parts after the first begin, as (id is not null, id, checksum), in order.

    Quantiles of the ids, and for each id of more than ``PART_ROWS`` documents
    (counted; fewer than there are parts) equal ranges of checksums.
    """
    n = docs.count()
    parts = min(PARTS, max(1, -(-n // PART_ROWS)))
    if parts == 1:
        return []
    found = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)
    bounds = {(True, int(b), 0) for b in found}
    least = max(PART_ROWS, n // PARTS)
    for row in docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > least).collect():
        known, i, pieces = row["doc_id"] is not None, row["doc_id"] or 0, -(-row["n"] // least)
        bounds |= {(known, i, (k << 32) // pieces) for k in range(pieces)}
        bounds |= {(True, i + 1, 0)} if known else set()
    return sorted(bounds)


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode the documents and write them as a data set under ``path``.

    The dictionary is trained on the first documents, ``SAMPLE_DOCUMENTS`` and
    ``SAMPLE_BYTES`` at most; it changes the size of the files alone.
    """
    from covlattice.llm.wordbpe import encoder

    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    trained = train_dictionary(_sample(docs, vocabulary, end_id, width))
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(trained, digest, width)], "data binary, sha256 string, width int").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )
    shared = spark.sparkContext.broadcast(trained)  # DICTIONARY_BYTES at most
    bounds = spark.sparkContext.broadcast(part_bounds(docs.select("doc_id")))  # two for each part at most

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_content_size=True)
        for batch in batches:
            counts, frames, checks, parts = [], [], [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = _serialised(enc, t.as_py(), end_id, width)
                counts.append(len(ids))
                frames.append(zip_.compress(ids.tobytes()))
                checks.append(zlib.crc32(frames[-1]))
                parts.append(bisect_right(bounds.value, (i is not None, i or 0, checks[-1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(*x) for x in ((counts, pa.int64()), (frames, pa.binary()), (checks, pa.int64()), (parts, pa.int32())))],
                names=["doc_id", "n", "frame", "crc", "part"],
            )

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, ids, counts, frames, size = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            offsets = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            row = {
                "part": part, "first": first, "n_ids": sum(counts), "dictionary": digest, "doc_ids": ids,
                "counts": counts, "offsets": offsets, "frames": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for p, i, n, f in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "frame"))):
                if ids and (p != part or size >= SEGMENT_BYTES):
                    yield flush()
                    first += sum(counts)
                    ids, counts, frames, size = [], [], [], 0
                if p != part:
                    part, first = p, 0
                ids.append(i)
                counts.append(n)
                frames.append(f)
                size += len(f)
        if ids:
            yield flush()

    schema = pa.schema([
        ("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("dictionary", pa.string()),
        ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
        ("frames", pa.binary()),
    ])
    framed = docs.mapInArrow(compress, "doc_id long, n long, frame binary, crc long, part int")
    (
        framed.repartitionById(len(bounds.value) + 1, "part")  # each part is a task of its own
        .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "crc", "frame")
        .mapInArrow(
            segment,
            "part int, first long, n_ids long, dictionary string, doc_ids array<long>, counts array<long>, "
            "offsets array<long>, frames binary",
        )
        .write.option("compression", "none")
        .parquet(f"{path}/segments")
    )


def _unpack(frames: memoryview, offsets: list[int], k: int, unzip: zstandard.ZstdDecompressor, width: int) -> np.ndarray:
    return np.frombuffer(unzip.decompress(frames[offsets[k] : offsets[k + 1]]), f"<u{width}")


def _unzipper(dictionary: bytes, digest: str) -> zstandard.ZstdDecompressor:
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the segment was written with another dictionary")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))


def read_token_files(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ``ids`` (32-bit little-endian bytes) of the documents, from the files.

    ``start`` counts the ids of all documents before.  ``only``: read these
    documents and nothing of the others but the index.
    """
    known = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, width = bytes(known["data"]), known["width"]
    shared = spark.sparkContext.broadcast(dictionary)
    segments = spark.read.parquet(f"{path}/segments")
    # a row for each range of ids
    totals = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, so_far = {}, 0
    for part in sorted(totals):
        before[part] = so_far
        so_far += totals[part]
    wanted = None if only is None else set(only)
    if only is not None:
        segments = segments.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in only])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                unzip = _unzipper(shared.value, row["dictionary"])
                frames, offsets = memoryview(row["frames"]), row["offsets"]
                at = before[row["part"]] + row["first"]
                out = ([], [], [], [])
                for k, (i, n) in enumerate(zip(row["doc_ids"], row["counts"])):
                    if wanted is None or i in wanted:
                        ids = _unpack(frames, offsets, k, unzip, width)
                        if len(ids) != n:
                            raise ValueError(f"document {i}: {len(ids)} ids where the index has {n}")
                        for column, x in zip(out, (i, at, n, ids.astype("<u4").tobytes())):
                            column.append(x)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_file_report(read: DataFrame) -> DataFrame:
    """The digest of :func:`read_token_files`: a checksum in place of the ids."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
