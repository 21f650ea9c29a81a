"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of an item.  Of every ``WINDOW - KGRAM
+ 1`` consecutive k-grams the smallest hash is kept, so two texts that share a
window keep the same hash within it.  The kept hashes of the items become a bit
filter of fixed size; a document's kept hashes that pass it are extended to the
windows around them, and those windows, as words, join the items' windows
exactly.  Items shorter than a window are one window of their own length; every
run of so many words of a document is tried against the filter.

The filter has ``FILTER_BITS`` bits whatever the benchmark holds; a larger
benchmark only lets more windows through to the join, which decides.  Neither
documents nor items meet in one task: a window found in many documents or items
joins by its text, and the items of windows are kept as classes (windows of the
same set of items), so that a passage shared by many documents and many items
is never expanded into pairs before the last step.

Defined results: null and empty texts have no words; an item without words
matches nothing; equal rows get equal results, one each; a null item id is
never listed; empty tables give no rows, or no hits.  Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covlattice.llm.common import cut_lineage, small, without_keys

WINDOW = 10
KGRAM = 5
#: Bits of the filter: 2 MB.
FILTER_BITS = 1 << 24
#: Bytes of text hashed together, and words of a document hashed at once (longer ones go in pieces).
BATCH_BYTES = 1 << 21
PIECE_WORDS = 1 << 18

_WORD = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and bytes above 127."""
    return (text or b"").translate(_WORD).split()


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int, known: dict = {}) -> np.ndarray:
    """base ** 0 to n - 1; a worker keeps the longest list so far."""
    if len(known.get(base, ())) < n:
        out = np.full(n + n // 2, base, np.uint64)
        out[0] = 1
        known[base] = np.cumprod(out, dtype=np.uint64)
    return known[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes."""
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Spans:
    """Hashes of runs of words in a list of documents, by prefix sums over their joined bytes."""

    def __init__(self, docs: list[list[bytes]]):
        counts = np.array([len(d) for d in docs], np.int64)
        lengths = np.fromiter((len(w) for d in docs for w in d), np.int64, int(counts.sum()))
        joined = b" ".join([b" ".join(d) for d in docs if d])
        data = np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(data)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(data * _powers(_BASE, n) if n else data, out=self._sums[1:])
        self._ends = np.cumsum(lengths + 1) - 1
        self._starts = self._ends - lengths
        self._back = _powers(_INVERSE, n)[self._starts] if n else np.zeros(0, np.uint64)
        self.first = np.r_[0, np.cumsum(counts)]
        #: Words from each word to the end of its document.
        self.left = np.repeat(self.first[1:], counts) - np.arange(len(lengths))

    def hashes(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; meaningless where the document ends before."""
        n = len(self._starts)
        last = np.minimum(np.arange(n) + k - 1, n - 1)
        return _mix((self._sums[self._ends[last]] - self._sums[self._starts]) * self._back)

    def winnowed(self, window: int, k: int) -> np.ndarray:
        """True where a k-gram has the smallest hash of a run of window - k + 1 k-grams; and all hashes."""
        h = self.hashes(k)
        n, width = len(h), window - k + 1
        kept = np.zeros(n, bool)
        whole = np.flatnonzero(self.left >= window)  # runs that a document holds whole
        if len(whole):
            smallest = h[whole]
            for d in range(1, width):
                smallest = np.minimum(smallest, h[whole + d])
            for d in range(width):
                kept[whole[h[whole + d] == smallest] + d] = True
        return np.flatnonzero(kept), h


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % FILTER_BITS


def _passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bits(h)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _batches(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Consecutive documents of about BATCH_BYTES, with the place of the first."""
    at, docs, size = 0, [], 0
    for place, text in enumerate(texts):
        docs.append(words_of(text))
        size += len(text or b"")
        if size >= BATCH_BYTES:
            yield at, docs
            at, docs, size = place + 1, [], 0
    if docs:
        yield at, docs


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, len, item_id) and the filter hashes of each: (hashes array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, docs in _batches(batch.column("text_").to_pylist()):
                spans = Spans(docs)
                kept, h = spans.winnowed(WINDOW, KGRAM)
                ids = batch.column("item_id_").slice(at, len(docs))
                rows = ([], [], [], [])
                for d, words in enumerate(docs):
                    if not words:
                        continue
                    n, size = len(words), min(WINDOW, len(words))
                    if n < WINDOW:
                        hashes = [Spans([words]).hashes(n)[0]]
                    else:
                        a, b = np.searchsorted(kept, spans.first[d : d + 2])
                        hashes = h[kept[a:b]]
                    hashes = np.array(hashes, np.uint64).view(np.int64)
                    for s in range(n - size + 1):
                        rows[0].append(b" ".join(words[s : s + size]))
                        rows[1].append(size)
                        rows[2].append(hashes if s == 0 else hashes[:0])
                        rows[3].append(d)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[0], pa.binary()),
                        pa.array(rows[1], pa.int32()),
                        pa.array(rows[2], pa.list_(pa.int64())),
                        ids.take(pa.array(rows[3], pa.int64())),
                    ],
                    names=["window", "len", "hashes", "item_id"],
                )

    chosen = items.select(F.col(f"`{item_id}`").alias("item_id_"), F.col(f"`{text}`").cast("binary").alias("text_"))
    kind = chosen.schema["item_id_"].dataType.simpleString()
    return chosen.mapInArrow(run, f"window binary, len int, hashes array<long>, item_id {kind}")


def _filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bit filter of the items' hashes (a fixed number of 64-bit words at most) and the short lengths."""
    bit = F.shiftrightunsigned(F.col("h"), 20) % FILTER_BITS
    words = (
        windows.select(F.explode("hashes").alias("h"))
        .select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast((shiftrightunsigned(h, 20) % {FILTER_BITS}) % 64 as int))").alias("b"))
        .groupBy("word")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["b"].to_numpy()
    short = [r["len"] for r in windows.where(F.col("len") < WINDOW).select("len").distinct().collect()]
    return bitmap.view(np.uint8), sorted(short)


def _candidates(docs: DataFrame, keys: list[str], text: str, bitmap: np.ndarray, short: list[int]) -> DataFrame:
    """keys, n_words, and of windows that pass the filter: their words, length and places."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # of a fixed size
    width = WINDOW - KGRAM + 1

    def found(docs_: list[list[bytes]]) -> list[list[dict]]:
        out: list[dict] = [{} for _ in docs_]
        step = PIECE_WORDS - (WINDOW - 1)
        cuts = [(d, at) for d, words in enumerate(docs_) for at in range(0, max(1, len(words) - WINDOW + 1), step)]
        if len(cuts) == len(docs_):
            search(docs_, out, [(d, 0, len(words)) for d, words in enumerate(docs_)])
        else:  # windows that start in the overlap belong to the next piece
            for d, at in cuts:
                rest = len(docs_[d]) - at
                search([docs_[d][at : at + PIECE_WORDS]], out, [(d, at, rest if rest <= PIECE_WORDS else step)])
        return [[{"window": w, "len": n, "starts": s} for (w, n), s in x.items()] for x in out]

    def search(pieces: list[list[bytes]], out: list[dict], owners: list[tuple[int, int, int]]) -> None:
        spans, bits = Spans(pieces), shared.value
        kept, h = spans.winnowed(WINDOW, KGRAM)
        kept = kept[_passes(bits, h[kept])]
        starts = np.unique((kept[:, None] - np.arange(width)[None, :]).ravel())
        starts = starts[starts >= 0]
        places = [(starts[spans.left[starts] >= WINDOW], WINDOW)]
        for n in short:
            at = np.flatnonzero(spans.left >= n)
            places.append((at[_passes(bits, spans.hashes(n)[at])], n))
        for at, n in places:
            piece = np.searchsorted(spans.first, at, "right") - 1
            for s, k in zip((at - spans.first[piece]).tolist(), piece.tolist()):
                d, offset, limit = owners[k]
                if s < limit:
                    out[d].setdefault((b" ".join(pieces[k][s : s + n]), n), []).append(s + offset)

    hit = pa.list_(
        pa.struct([("window", pa.binary()), ("len", pa.int32()), ("starts", pa.list_(pa.int32()))])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, docs_ in _batches(batch.column("text_").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(at, len(docs_)) for k in keys),
                        pa.array([len(d) for d in docs_], pa.int64()),
                        pa.array(found(docs_), hit),
                    ],
                    names=[*keys, "n_words", "hits"],
                )

    chosen = docs.select(*keys, F.col(f"`{text}`").cast("binary").alias("text_"))
    types = "".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}, " for k in keys)
    return chosen.mapInArrow(
        run, f"{types}n_words long, hits array<struct<window: binary, len: int, starts: array<int>>>"
    )


def covered_words(spans: Column) -> Column:
    """Words in the union of (start, end) spans."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"].cast("long"),
    )


def _matches(docs: DataFrame, items: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates of all documents; (row_, n_hit, classes) of those with hits; (class, item_id)."""
    windows = cut_lineage(item_windows(items))
    bitmap, short = _filter(windows)
    rows = docs.select(*keys, F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row_"))
    tried = cut_lineage(_candidates(rows, [*keys, "row_"], "text", bitmap, short))
    listed = windows.where("item_id IS NOT NULL").select("window", "item_id").distinct()
    h = F.xxhash64("item_id")
    classes = cut_lineage(
        windows.select("window").distinct().join(
            listed.groupBy("window").agg(
                F.count("*").alias("c0"), F.bit_xor(h).alias("c1"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("c2")
            ),
            "window",
            "left",
        ).select("window", F.struct(F.coalesce("c0", F.lit(0)).alias("c0"), "c1", "c2").alias("class"))
    )
    one = classes.groupBy("class").agg(F.min("window").alias("window"))
    members = one.join(listed, "window").select("class", "item_id")
    met = (
        tried.select("row_", F.explode("hits").alias("hit"))
        .select("row_", "hit.window", "hit.len", "hit.starts")
        .join(classes, "window")
        .select(
            "row_",
            "class",
            F.transform("starts", lambda s: F.struct(s.alias("start"), (s + F.col("len")).alias("end"))).alias("spans"),
        )
    )
    hits = met.groupBy("row_").agg(
        covered_words(F.flatten(F.collect_list("spans"))).alias("n_hit"), F.sort_array(F.collect_set("class")).alias("classes")
    )
    return tried, hits, members


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit and item_ids (sorted as strings) of every document."""
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    tried, hits, members = _matches(named, items, ["doc_id"], "text")
    hits = cut_lineage(hits)
    sets = hits.select("classes").distinct()
    listed = (
        sets.select("classes", F.explode("classes").alias("class"))
        .join(members, "class")
        .select("classes", F.col("item_id").cast("string").alias("item_id"))
        .distinct()
        .groupBy("classes")
        .agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    )
    return (
        tried.select("doc_id", "row_", "n_words")
        .join(hits.join(listed, "classes", "left"), "row_", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of :func:`contamination`: n_items and a hash in place of the item ids."""
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no window of an item, with their columns."""
    key = [F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))]
    keyed = docs.select(key[0].alias("id_"), key[1].alias("content_"), F.col(f"`{text}`").alias("text"))
    tried, hits, _ = _matches(keyed, items, ["id_", "content_"], "text")
    found = tried.join(small(cut_lineage(hits.select("row_"))), "row_", "left_semi").select("id_", "content_").distinct()
    return without_keys(docs, key, cut_lineage(found))
