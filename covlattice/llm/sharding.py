"""Sharding by histogram sort (native DataFrame expressions).

Documents get a 63-bit key: text hash, then id hash, then a salt, so that equal
texts stand together and yet a group of any size can be split.  Splitters are
found by counting: one aggregation gives the exact bytes of 4,096 ranges of
keys; those ranges in which a wanted splitter lies are counted again in 256
parts each, until every splitter is within the tolerance.  The bits of id and
salt are looked at only within a text hash that has more than ``GROUP_SHARE`` of
a shard's bytes, so that equal texts share a shard unless they are more than
that; a splitter goes to the nearer end of a smaller group.  Only these counts
come to the driver: a number of rows that depends on the shards, never on the
input.  Then rows are exchanged once, by splitters.

The slots of a shard are numbered by many tasks: its rows fall into cells by a
hash of their key, a cell is numbered on its own, and the counts of the cells
give where each begins.

Defined results: a null text has no bytes, counts as ``OVERHEAD`` bytes and has
checksum 0; equal rows are different rows with slots of their own; an empty
table gives no rows; other columns pass through :func:`write_shards`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covlattice.llm.common import cut_lineage, fresh, small

SHARDS = 40
#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Share of a shard's bytes by which a splitter may be off.
TOLERANCE = 0.002
#: Equal texts of more than this share of a shard's bytes may be split.
GROUP_SHARE = 0.1
#: Rows that a cell is meant to hold at most.
CELL_ROWS = 2_000_000
#: Files of a shard that :func:`write_shards` writes.
PARTS = 8
_KEY_BITS, _FIRST_BITS, _NEXT_BITS = 63, 12, 8
#: Bits of id and salt, below those of the text.
_INNER_BITS = 32


def document_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def sort_key(text: Column, doc_id: Column) -> Column:
    """31 bits of the text, 16 of the id, 16 of the row's place in its input."""
    by_text = F.shiftrightunsigned(F.xxhash64(text), 33)
    by_id = F.shiftrightunsigned(F.xxhash64(doc_id), 48)
    salt = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 48)
    return F.shiftleft(by_text, 32).bitwiseOR(F.shiftleft(by_id, 16)).bitwiseOR(salt)


def _count(keys: DataFrame, width: int) -> list[tuple[int, int, int]]:
    """(prefix, bytes, rows) of the key ranges 2 ** width wide that hold rows, in order."""
    found = keys.groupBy(F.shiftright("key", width).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    return sorted((r["p"], r["s"], r["n"]) for r in found.collect())


def find_splitters(keys: DataFrame, pieces: int, tolerance: float = TOLERANCE, group: float = GROUP_SHARE) -> list[int]:
    """Keys that cut ``keys`` (key, size) into ``pieces`` ranges of nearly equal bytes.

    Each is within ``tolerance`` of the bytes of a piece, or as near as whole
    rows allow, and whole groups of up to ``group`` of a piece.  A row belongs
    after the splitters that are not above its key.
    """
    width = _KEY_BITS - _FIRST_BITS
    counts = _count(keys, width)
    total = sum(c[1] for c in counts)
    if not total:
        return []
    starts = np.array([c[0] << width for c in counts], np.int64)
    size = np.array([c[1] for c in counts], np.int64)
    rows = np.array([c[2] for c in counts], np.int64)
    widths = np.full(len(counts), width)
    wanted = np.array([total * j // pieces for j in range(1, pieces)], np.int64)
    slack, large = tolerance * total / pieces, group * total / pieces
    while True:
        below = np.r_[0, np.cumsum(size)]
        at = np.clip(np.searchsorted(below, wanted, "right") - 1, 0, len(starts) - 1)
        off = np.minimum(wanted - below[at], below[at + 1] - wanted)
        whole = (widths[at] == _INNER_BITS) & (size[at] <= large)
        open_ = np.unique(at[(off > slack) & (rows[at] > 1) & (widths[at] > 0) & ~whole])
        if not len(open_):
            break
        width = int(widths[open_].max())
        open_ = open_[widths[open_] == width]
        step = min(_NEXT_BITS, width - _INNER_BITS if width > _INNER_BITS else width)  # the text's bits first
        within = [int(s) >> width for s in starts[open_]]
        inner = _count(keys.where(F.shiftright("key", width).isin(within)), width - step)
        keep = np.ones(len(starts), bool)
        keep[open_] = False
        starts = np.r_[starts[keep], [c[0] << (width - step) for c in inner]].astype(np.int64)
        size, rows = (np.r_[old[keep], [c[k] for c in inner]].astype(np.int64) for old, k in ((size, 1), (rows, 2)))
        widths = np.r_[widths[keep], np.full(len(inner), width - step)]
        order = np.argsort(starts)
        starts, size, rows, widths = starts[order], size[order], rows[order], widths[order]
    nearer = (below[at + 1] - wanted < wanted - below[at]).astype(int)
    ends = np.r_[starts, np.iinfo(np.int64).max]
    return [int(x) for x in np.maximum.accumulate(ends[at + nearer])]


def place_among(key: Column, splitters: list[int]) -> Column:
    """How many splitters are not above the key: a binary search by an ordered fold."""
    if not splitters:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    padded = splitters + [np.iinfo(np.int64).max] * (2 * steps[0] - len(splitters))
    table = F.array(*[F.lit(int(s)) for s in padded])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.get(table, at + s - 1) <= key, at + s).otherwise(at),
    )


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    t, i = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    return sort_key(t, i), document_size(t)


def assign_shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot of every document.

    ``shard`` is an int from 0 to ``shards`` - 1; ``slot`` numbers its rows from 0.
    """
    key, size = _keyed(docs, doc_id, text)
    rows = cut_lineage(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            size.alias("size"),
            F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_crc32"),
            key.alias("key"),
        )
    )
    cells = max(1, -(-rows.count() // (shards * cell_rows)))
    splitters = find_splitters(rows.select("key", "size"), shards)
    placed = rows.withColumn("shard", place_among(F.col("key"), splitters).cast("int"))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) OVER (PARTITION BY shard ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    first = cut_lineage(counts.select("shard", "cell", before.alias("first")))  # a row for ``cell_rows`` rows or so
    placed = placed.withColumn("number", F.expr("row_number() OVER (PARTITION BY shard, cell ORDER BY key, doc_id, text_crc32)"))
    return placed.join(small(first), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "key", "shard", (F.col("first") + F.col("number") - 1).alias("slot")
    )


def shard_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null)."""
    return assign_shards(docs, doc_id, text, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, parts: int = PARTS
) -> str:
    """Write the rows of ``docs`` as Parquet under ``path``/shard=N, ``parts`` files a shard, each in key order.

    Texts are read twice: for their keys, which are written and counted, and
    for the one exchange of whole rows.  The salt of the second reading may
    differ from that of the first; it only tells equal rows apart.  Gives the
    name of the column of the shard, another one than ``shard`` if ``docs`` has that.
    """
    key, size = _keyed(docs, doc_id, text)
    splitters = find_splitters(cut_lineage(docs.select(key.alias("key"), size.alias("size"))), shards)
    key_, part_ = fresh(docs, "key"), fresh(docs, "part")
    shard_ = fresh(docs, "shard") if "shard" in {c.lower() for c in docs.columns} else "shard"
    placed = docs.withColumn(key_, key).withColumn(shard_, place_among(F.col(key_), splitters).cast("int"))
    (
        placed.withColumn(part_, (F.col(shard_) * parts + F.pmod(F.xxhash64(key_), F.lit(parts))).cast("int"))
        .repartitionById(shards * parts, part_)
        .sortWithinPartitions(key_)
        .drop(key_, part_)
        .write.partitionBy(shard_)
        .parquet(path)
    )
    return shard_
