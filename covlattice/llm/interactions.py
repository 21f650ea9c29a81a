"""Filter interaction audit: what each filter removes in every order of filters.

Every document is tried once by every filter.  Per part and range of ids the
ids that fail a filter are kept as a sorted posting list (positions in the
range, in the order of ids), beside those of good and of toxic labels.  A k-way
merge over the lists of a range, which gallops through the stretches that one
list has alone, gives the sizes of the lists' disjoint cells: how many ids
exactly these lists hold.  Sizes are summed over the ranges; every union of
earlier filters, and every difference to it, is a sum of cells.

Scale: texts are read once, for the failures and a digest; identical texts meet
by digest, of which only those that repeat are joined back (hot ones by
broadcast).  Rows of a few bytes are written once and dealt by ranges of (part,
id), so a part with a third of all rows is many ranges; a task holds the lists
of one range of ``RANGE_ROWS`` rows and sends on cells.

Defined results: a null text is the empty text, a null part the part ''; rows
with the same id are documents of their own, in the order of their failures; a
null id is neither smaller nor larger than another and has no label; several
labels of an id count if one of them does; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covlattice.llm.common import cut_lineage, left_join_skewed

#: Rows of a range at most.
RANGE_ROWS = 1 << 16

_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def _few_words(text: bytes, words: list[bytes], n_chars: int) -> bool:
    return len(words) < 200


def _repetitive(text: bytes, words: list[bytes], n_chars: int) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def _shouting(text: bytes, words: list[bytes], n_chars: int) -> bool:
    return 100 * (len(text) - len(text.translate(None, _UPPER))) > 2 * n_chars


def _marked(text: bytes, words: list[bytes], n_chars: int) -> bool:
    return len(text) != len(text.translate(None, _MARKS))


#: Filters by letter: a test of (text, its words, its code points) that is true for a failing text.
FILTERS: dict[str, Callable[[bytes, list[bytes], int], bool]] = {"A": _few_words, "B": _repetitive, "C": _shouting, "D": _marked}
#: The letter of the filter that removes texts which a smaller id has too.
COPIES = "E"


def filter_failures(
    docs: DataFrame, filters: dict[str, Callable] | None = None, copies: str | None = COPIES,
    doc_id: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """part, doc_id, lists of every document: bit k of ``lists`` is set if it fails the filter of the k-th letter.

    The letters are those of ``filters``, then ``copies`` if given.  Functions
    get the text's UTF-8 and its words, maximal runs without ASCII white space.
    """
    tests = list((FILTERS if filters is None else filters).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, digests = [], []
            for t, n in zip(batch.column("text_"), batch.column("n_chars").to_pylist()):
                raw = t.as_py()
                words = raw.split()
                failed.append(sum(1 << k for k, test in enumerate(tests) if test(raw, words, n)))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())],
                names=["part", "doc_id", "lists", "digest"],
            )

    chosen = docs.select(
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_"),
    ).withColumns({"n_chars": F.char_length("text_"), "text_": F.col("text_").cast("binary")})
    kind = chosen.schema["doc_id"].dataType.simpleString()
    tried = chosen.mapInArrow(run, f"part string, doc_id {kind}, lists int, digest binary")
    if copies is None:
        return tried.drop("digest")
    tried = cut_lineage(tried)
    groups = tried.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    met = left_join_skewed(tried, cut_lineage(groups.where("n > 1")), "digest")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return met.select("part", "doc_id", F.col("lists").bitwiseOR(F.when(later, 1 << len(tests)).otherwise(0)).alias("lists"))


def with_labels(failures: DataFrame, labels: DataFrame, n_filters: int, doc_id: str = "doc_id") -> DataFrame:
    """``failures`` with two more bits in ``lists``: labelled quality 1, and toxic 1."""
    good, toxic = (F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")) for c in ("quality", "toxic"))
    told = labels.groupBy(F.col(f"`{doc_id}`").alias("doc_id")).agg((good * (1 << n_filters) + toxic * (2 << n_filters)).cast("int").alias("told"))
    met = failures.join(told.where("told > 0 AND doc_id IS NOT NULL"), "doc_id", "left")
    return met.select("part", "doc_id", F.col("lists").bitwiseOR(F.coalesce("told", F.lit(0))).alias("lists"))


def posting_lists(rows: DataFrame, n_lists: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """part, first_id, last_id, n_rows, postings of every range of ids: ``postings[k]`` are the sorted positions whose bit k is set."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_ = None

        def made(part: str, ids: list, lists: list[list[int]], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([ids[0]], type_), pa.array([ids[1]], type_), pa.array([n], pa.int64()),
                 pa.array([lists], pa.list_(pa.list_(pa.int32())))],
                names=["part", "first_id", "last_id", "n_rows", "postings"],
            )

        now, ids, lists, n = None, [None, None], [], 0
        for batch in batches:
            type_ = batch.column("doc_id").type
            for part, i, held in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "lists"))):
                if n and (part != now or n >= range_rows):
                    yield made(now, ids, lists, n)
                    n = 0
                if not n:
                    now, ids, lists = part, [i, i], [[] for _ in range(n_lists)]
                while held:
                    low = held & -held
                    lists[low.bit_length() - 1].append(n)
                    held ^= low
                ids[1] = i
                n += 1
        if n:
            yield made(now, ids, lists, n)

    dealt = rows.repartitionByRange("part", "doc_id", "lists").sortWithinPartitions("part", "doc_id", "lists")
    return dealt.mapInArrow(
        run, f"part string, first_id {kind}, last_id {kind}, n_rows long, postings array<array<int>>"
    )


def gallop(ids: Sequence[int], at: int, least: int) -> int:
    """The first place from ``at`` on whose id is ``least`` or more: steps that double, then a binary search between the last two."""
    step, low = 1, at
    while at < len(ids) and ids[at] < least:
        low, at, step = at + 1, at + step, 2 * step
    return bisect_left(ids, least, low, min(at, len(ids)))


def merge_cells(lists: Sequence[Sequence[int]]) -> Counter[int]:
    """How many ids exactly the lists of a bit mask hold, by mask: a k-way merge of sorted lists without repeats."""
    cells: Counter[int] = Counter()
    at = [0] * len(lists)
    live = [k for k, ids in enumerate(lists) if ids]
    while live:
        heads = [lists[k][at[k]] for k in live]
        least = min(heads)
        who = [k for k, h in zip(live, heads) if h == least]
        if len(who) > 1:
            cells[sum(1 << k for k in who)] += 1
            for k in who:
                at[k] += 1
        else:  # alone up to the next head of another list
            k = who[0]
            others = [h for h in heads if h != least]
            end = gallop(lists[k], at[k], min(others)) if others else len(lists[k])
            cells[1 << k] += end - at[k]
            at[k] = end
        live = [k for k in live if at[k] < len(lists[k])]
    return cells


def cell_sizes(postings: DataFrame) -> DataFrame:
    """part, cell, n: the rows of a part that exactly the lists of the mask ``cell`` hold; cell 0 holds those in no list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, lists in zip(*(batch.column(c).to_pylist() for c in ("part", "n_rows", "postings"))):
                cells = merge_cells(lists)
                cells[0] = n - sum(cells.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(cells)), pa.array(list(cells), pa.int32()), pa.array(list(cells.values()), pa.int64())],
                    names=["part", "cell", "n"],
                )

    found = postings.select("part", "n_rows", "postings").mapInArrow(run, "part string, cell int, n long")
    return found.groupBy("part", "cell").agg(F.sum("n").alias("n"))


def order_effects(cells: dict[int, int], letters: str) -> Iterator[tuple]:
    """Rows of all orders of the filters: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``cells`` are the sizes of one part's cells; the two bits after those of
    the filters are good and toxic.
    """
    k = len(letters)
    good, toxic = 1 << k, 2 << k

    def size(inside: int, outside: int) -> int:
        """Rows in all lists of ``inside`` and none of ``outside``."""
        return sum(n for c, n in cells.items() if c & inside == inside and not c & outside)

    steps = {}
    for before in range(1 << k):
        for f in range(k):
            if not before >> f & 1:
                own = 1 << f
                removed = size(own, before)
                steps[before, f] = (
                    size(0, before | own), removed, size(own, 0) - removed, size(own, ((1 << k) - 1) ^ own),
                    size(own | good, before), size(own | toxic, before),
                )
    shapley, rows = [0] * k, []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            shapley[f] += steps[before, f][1]
            rows.append(("".join(letters[x] for x in order), step, before, f))
            before |= 1 << f
    for name, step, before, f in rows:
        yield (name, step, *steps[before, f], shapley[f])


_EFFECTS = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def interaction_audit(cells: DataFrame, letters: str) -> DataFrame:
    """:func:`order_effects` of every part, from its at most 2^(filters + 2) cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                rows = list(zip(*order_effects({c["cell"]: c["n"] for c in held}, letters)))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows[0])), *(pa.array(x, t) for x, t in zip(rows, kinds))], names=["part", *_EFFECTS]
                )

    held = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    counts = ", ".join(f"{c} long" for c in _EFFECTS[2:])
    return held.mapInArrow(run, f"part string, filter_order string, step int, {counts}")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters ``FILTERS`` and ``COPIES`` over whole texts, by source."""
    letters = "".join(FILTERS) + COPIES
    rows = cut_lineage(with_labels(filter_failures(docs), labels, len(letters)))
    return interaction_audit(cell_sizes(posting_lists(rows, len(letters) + 2)), letters)
