"""Near-duplicates by SimHash: tiled exact comparison of all fingerprints.

A fingerprint has 64 bits; two documents link if at most ``RADIUS`` bits
differ.  Equal fingerprints are one node.  The nodes are dealt into tiles by
the population counts of their two halves; the counts of two fingerprints
differ by no more than their bits do, so tiles whose counts differ by more than
the radius are never paired.  Each remaining pair of tiles is compared whole
with numpy exclusive-or and bit counts, in blocks, and gives a spanning forest
of the links found, never the links themselves: a group of any size leaves
fewer rows than it has nodes and no component loses a link that joins it.

The comparison grows with the square of the distinct fingerprints; tiles and
their pairs spread it evenly, and the shuffled bytes grow with that square over
``TILE`` only.

Defined results: a null or empty text has no words and fingerprint zero, and
links like any other; equal rows are in one component; an empty table gives no
rows; other columns are not looked at; a null id counts as no id, so a
component of null ids alone has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covlattice.llm.common import cut_lineage, left_join_skewed, small, with_keys, without_keys
from covlattice.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Most fingerprints in a tile: half a megabyte.
TILE = 65_536
#: Comparisons in a block of two tiles.
BLOCK = 1 << 18
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text as a signed 64-bit number."""
    import xxhash

    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    total = max(len(words) - shingle + 1, 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        if len(part) <= shingle:
            hashes = [digest(b" ".join(part), SEED)]
        else:
            hashes = [digest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(shingle)))]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keys`` of every row with its fingerprint ``fp`` (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t, shingle) for t in batch.column("text_").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(fps, pa.int64())], names=[*keys, "fp"]
            )

    chosen = docs.select(*keys, F.col(f"`{text}`").cast("binary").alias("text_"))
    types = ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keys)
    return chosen.mapInArrow(run, f"{types}, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the sets of i and j; label holds the smallest index of each set."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(deeper := label[label], label):
            label = deeper


def _quarters(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the fingerprints by the counts of their four quarters, and those counts in that order."""
    counts = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(counts.T)
    return order, counts[order]


def links_within(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles (or within one, b None).

    Both sides are ordered by the counts of their quarters; a block of one side
    is compared with those runs of the other whose counts are within the
    radius.
    """
    nodes = a if b is None else np.concatenate([a, b])
    label = np.arange(len(nodes))
    order_a, counts_a = _quarters(a)
    order_b, counts_b = (order_a, counts_a) if b is None else _quarters(b)
    off = 0 if b is None else len(a)
    other = a if b is None else b
    starts = np.flatnonzero(np.r_[True, (counts_b[1:] != counts_b[:-1]).any(axis=1)])
    ends = np.r_[starts[1:], len(counts_b)]
    kinds = counts_b[starts]
    step = max(1, min(256, BLOCK // max(1, len(other))))
    for at in range(0, len(order_a), step):
        mine = order_a[at : at + step]
        low, high = counts_a[at : at + step].min(axis=0), counts_a[at : at + step].max(axis=0)
        gap = np.maximum(np.maximum(kinds - high, low - kinds), 0).sum(axis=1)
        near = gap <= radius
        if not near.any():
            continue
        chosen = order_b if near.all() else order_b[np.repeat(near, ends - starts)]
        i, j = np.nonzero(np.bitwise_count(a[mine][:, None] ^ other[chosen][None, :]) <= radius)
        i, j = mine[i], chosen[j] + off
        if b is None:
            i, j = i[i < j], j[i < j]
        if len(i):
            label = _merge(label, i, j)
    far = np.flatnonzero(label != np.arange(len(label)))
    return nodes[far], nodes[label[far]]


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span the components of the distinct ``fp`` of ``nodes``."""
    cells = nodes.select(
        "fp",
        F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int").alias("hi"),
        F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("lo"),
    )
    # 33 x 33 cells at most, whatever the input
    sizes = cut_lineage(cells.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    tiles = (
        cells.join(F.broadcast(sizes), ["hi", "lo"])
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("hi", "lo", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    offsets = [
        (x, y)
        for x in range(-radius, radius + 1)
        for y in range(-radius, radius + 1)
        if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)
    ]
    near = sizes.select(
        "hi",
        "lo",
        "parts",
        F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets])).alias("o"),
    ).select("hi", "lo", "parts", (F.col("hi") + F.col("o.x")).alias("hi2"), (F.col("lo") + F.col("o.y")).alias("lo2"))
    there = sizes.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("parts").alias("parts2"))
    pairs = (
        near.join(F.broadcast(there), ["hi2", "lo2"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
        .where("hi != hi2 OR lo != lo2 OR part <= part2")
        .withColumn("pair", F.xxhash64("hi", "lo", "part", "hi2", "lo2", "part2"))
    )
    first = F.struct("hi", "lo", "part")
    second = F.struct(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("part2").alias("part"))
    # a tile paired with itself comes once
    sides = pairs.select(
        F.struct("hi", "lo", "part", "hi2", "lo2", "part2").alias("pair"), F.explode(F.array_distinct(F.array(first, second))).alias("t")
    ).select("pair", "t.hi", "t.lo", "t.part")
    work = sides.join(tiles, ["hi", "lo", "part"]).groupBy("pair").agg(F.collect_list("fps").alias("sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sides_ in batch.column("sides"):
                parts = [s.values.to_numpy(zero_copy_only=False).view(np.uint64) for s in sides_.values]
                a, b = links_within(parts[0], parts[1] if len(parts) > 1 else None, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
                    )

    return work.select("sides").mapInArrow(run, "a long, b long")


def group_heads(fps: DataFrame, head: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, n, head): rows of a fingerprint, and the smallest ``head`` of its component.

    Only fingerprints that several rows have, or that have a link, are listed.
    All joins are of distinct fingerprints.
    """
    per = cut_lineage(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min(head).alias("head")))
    found = cut_lineage(components(fingerprint_links(per.select("fp"), radius)).withColumnRenamed("node", "fp"))
    linked = cut_lineage(per.join(small(found), "fp"))
    roots = linked.groupBy("root").agg(F.min("head").alias("first"), F.count("*").alias("n_"))
    joined = left_join_skewed(linked, cut_lineage(roots), "root", "n_").select("fp", "n", F.col("first").alias("head"))
    alone = per.where("n > 1").join(small(found.select("fp")), "fp", "left_anti")
    return cut_lineage(alone.unionByName(joined))


def near_duplicates(
    docs: DataFrame, keys: list[str], head: Column, text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """``keys`` of every row, ``fp``, and ``head``: the smallest of the row's component; null where the row is alone."""
    fps = cut_lineage(fingerprints(docs, keys, text, shingle))
    return left_join_skewed(fps, group_heads(fps, head, radius), "fp")


def near_duplicate_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id of the component."""
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    member = near_duplicates(keyed, ["doc_id"], F.col("doc_id"))
    return member.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), F.coalesce("head", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, one for each component: that of the smallest id (ids before nulls).

    Rows equal in id and text are one document and give one row.  Only the ids
    and content hashes of the rows to drop are joined to the documents.
    """
    key = [F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))]
    keyed = docs.select(key[0].alias("_id"), F.col(f"`{text}`").alias("text"), key[1].alias("_content"))
    head = F.struct(F.col("_id").isNull().alias("none"), "_id", "_content")
    member = near_duplicates(keyed, ["_id", "_content"], head).where("head IS NOT NULL")
    first = F.col("_id").eqNullSafe(F.col("head._id")) & (F.col("_content") == F.col("head._content"))
    times = cut_lineage(member.groupBy("_id", "_content").agg(F.bool_and(first).alias("first"), F.count("*").alias("n")))
    gone = times.where("NOT first OR n > 1").select("_id", "_content")
    kept = without_keys(docs, key, gone)
    repeated = times.where("first AND n > 1").select("_id", "_content")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(with_keys(docs, key, repeated).dropDuplicates([doc_id, text]))
