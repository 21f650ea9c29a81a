"""Hard-negative mining by an exact multiway hyperplane tree.

A tree of split points is fitted on a bounded sample: a node has up to ``WAYS``
split points far apart, and a row goes to the subtree of the nearest one.  All
rows are then put into the leaves, and every node keeps, for each split point
and each sibling subtree, the least and largest distance between them, over all
rows.  A search for scores (inner products) in a window asks, at each node, how
far a row with such a score can be from the anchor: with the norms that a
subtree holds, the window is an annulus around the anchor.  Subtrees whose
distances, bounded through any of the sibling split points by the triangle
inequality, miss the annulus are dropped.  Leaves that are left are searched
exactly, so nothing is lost; the sample decides the speed only.

Scale: rows of a leaf are kept as blocks of ``BLOCK_ROWS`` in the order of their
distance to its split point, written once, so a leaf with a third of all rows
is many blocks in many tasks; a block keeps ranges of its own.  Two passes, for
positives and for negatives: each first raises the lower ends of an anchor's
windows to what its best matches in the sample score, since no worse row can be
among the first; then the anchor goes, in a pack, to the leaves it can't drop,
and a task streams the packs past a few blocks.  The sample, the tree (split
points of the sample) and its ranges are all that is broadcast.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; shorter vectors end in zeros; rows with
equal ids are rows of their own (an anchor is apart from its own row only); an
empty table gives no rows; other columns are not looked at.  Components are
whole numbers; scores are exact, and held at the ends of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covlattice.llm.common import cut_lineage

#: Rows that the tree is fitted on at most, and split points of a node.
SAMPLE, WAYS = 16_384, 16
#: Rows that a leaf should hold, and rows of a block at most.
LEAF_ROWS, BLOCK_ROWS = 1_024, 512
#: Blocks that are searched together, about; anchors of a pack at most.
SLOT_BLOCKS, PACK = 4, 256
#: Widens distances against rounding, as a part of the norms.
SLACK = 1e-6

LOWEST, HIGHEST = -(2**63), 2**63 - 1


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of a by rows of b) of whole numbers, held within 64 bits."""
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if reach < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(b).T), LOWEST, HIGHEST).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Node(NamedTuple):
    """Split points, and for each the child node (0 or more) or the leaf (-1 - leaf)."""

    points: np.ndarray
    children: list[int]


def _apart(rows: np.ndarray, ways: int, rng: np.random.Generator) -> np.ndarray:
    """Rows far from each other: of some candidates, again and again the one farthest from those chosen."""
    found = rows[rng.choice(len(rows), min(len(rows), 3 * ways), replace=False)]
    chosen = [0]
    near = distances(found, found[:1])[:, 0]
    while len(chosen) < ways and near.max() > SLACK * (1 + np.abs(found).max()):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(found, found[chosen[-1:]])[:, 0])
    return found[chosen]


class Tree:
    """The tree's nodes; ``paths[leaf]`` lists the (node, child) from the root down."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, ways: int = WAYS, seed: int = 0):
        self.nodes: list[Node] = []
        self.paths: list[list[tuple[int, int]]] = []
        rng = np.random.default_rng(seed)
        todo: list[tuple[np.ndarray, list[tuple[int, int]]]] = [(sample, [])]
        while todo:
            rows, path = todo.pop()
            points = _apart(rows, ways, rng) if len(rows) > leaf_rows else rows[:0]
            if len(points) < 2:
                self._hang(path, -1 - len(self.paths))
                self.paths.append(path)
                continue
            self._hang(path, len(self.nodes))
            here = len(self.nodes)
            self.nodes.append(Node(points, [0] * len(points)))
            nearest = distances(rows, points).argmin(1)
            todo += [(rows[nearest == k], [*path, (here, k)]) for k in range(len(points))]

    def _hang(self, path: list[tuple[int, int]], what: int) -> None:
        if path:
            self.nodes[path[-1][0]].children[path[-1][1]] = what

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of every row, and its distance to the leaf's own split point."""
        leaf, near = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        todo = [(0, np.arange(len(rows)))] if self.nodes else []
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            far = distances(rows[who], node.points)
            nearest = far.argmin(1)
            for k, child in enumerate(node.children):
                own = who[nearest == k]
                if child >= 0:
                    todo.append((child, own))
                else:
                    leaf[own], near[own] = -1 - child, far[nearest == k, k]
        return leaf, near

    def points(self, leaf: int) -> np.ndarray:
        """The split points of all nodes on the way to a leaf."""
        return np.concatenate([self.nodes[n].points for n, _ in self.paths[leaf]] or [np.zeros((0, 0))])


class Ranges:
    """Per node the least and largest distance of its split points (rows) to its subtrees (columns), and their norms."""

    def __init__(self, tree: Tree, leaves: dict[int, tuple[float, float, np.ndarray, np.ndarray]]):
        """``leaves``: least and largest squared norm, least and largest distances to ``tree.points``; empty leaves are left out."""
        self.tree = tree
        self.low = [np.full((len(n.points),) * 2, np.inf) for n in tree.nodes]
        self.high = [np.full((len(n.points),) * 2, -np.inf) for n in tree.nodes]
        self.norms = [np.tile([np.inf, -np.inf], (len(n.points), 1)) for n in tree.nodes]
        for leaf, (least, most, near, far) in leaves.items():
            at = 0
            for n, k in tree.paths[leaf]:
                m = len(tree.nodes[n].points)
                self.low[n][:, k] = np.minimum(self.low[n][:, k], near[at : at + m])
                self.high[n][:, k] = np.maximum(self.high[n][:, k], far[at : at + m])
                self.norms[n][k] = min(self.norms[n][k, 0], least), max(self.norms[n][k, 1], most)
                at += m

    def survivors(self, anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of the anchors that can't drop it); lows and highs are the windows of every anchor, one a column."""
        square = (anchors * anchors).sum(1)
        todo: list[tuple[int, np.ndarray]] = []
        if not self.tree.nodes:
            yield 0, np.flatnonzero((lows <= highs).any(1))
        elif len(anchors):
            todo.append((0, np.arange(len(anchors))))
        while todo:
            at, who = todo.pop()
            node = self.tree.nodes[at]
            to_points = distances(anchors[who], node.points)
            near, far = reach(to_points, self.low[at], self.high[at])
            open_ = np.zeros(near.shape, bool)
            for w in range(lows.shape[1]):
                open_ |= meets(square[who], lows[who, w], highs[who, w], near, far, self.norms[at])
            for k, child in enumerate(node.children):
                left = who[open_[:, k]]
                if len(left) and np.isfinite(self.norms[at][k]).all():
                    if child >= 0:
                        todo.append((child, left))
                    else:
                        yield -1 - child, left


def reach(to_points: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distances between anchors and the rows of subtrees, from those to the split points (triangle inequality)."""
    to = to_points[:, :, None]
    near = np.maximum(np.maximum(to - high, low - to), 0).max(1)
    return near, (to + high).min(1)


def meets(square: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Can rows at distances ``near`` to ``far``, of squared norms ``norms``, have a score between low and high?"""
    slack = SLACK * (1 + np.sqrt(square)[:, None] + np.sqrt(np.maximum(norms[None, :, 1], 0)))
    low, high = low.astype(float)[:, None], high.astype(float)[:, None]
    outer = square[:, None] + norms[None, :, 1] - 2 * low  # largest squared distance that the window allows
    inner = np.maximum(square[:, None] + norms[None, :, 0] - 2 * high, 0)
    return (low <= high) & (near <= np.sqrt(np.maximum(outer, 0)) + slack) & (far >= np.sqrt(inner) - slack)


def best(
    scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k allowed entries of each row that come first, by score downwards, then id."""
    if scores.shape[1] > 4 * k:
        shown = np.where(allowed, scores, LOWEST)
        least = np.partition(shown, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        allowed = allowed & (scores >= least[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((uids[column], ids[column], ~scores[row, column], row))  # ~score: downwards, without an overflow
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


# packed columns: ids and windows as 64-bit integers, vectors as the smallest type that holds all of a pack


def _pack(m: np.ndarray) -> tuple[int, bytes]:
    most = np.abs(m).max(initial=0)
    kind = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return kind, np.ascontiguousarray(m, {2: np.int16, 4: np.int32, 8: np.float64}[kind]).tobytes()


def _unpack(kind: int, raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.float64}[kind]).astype(float).reshape(-1, dim)


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


_BLOCK = (
    "leaf int, block long, n int, uids binary, ids binary, labels binary, kind int, vectors binary, norm_low double, norm_high double, "
    "near array<double>, far array<double>, anchors binary"
)
_SENT = "leaf int, slot int, side int, uids binary, ids binary, labels binary, kind int, vectors binary, lows binary, highs binary"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a batch as rows that end in zeros."""
    ends = column.offsets.to_numpy()
    m = np.zeros((len(column), dim))
    values = column.values.to_numpy(zero_copy_only=False)
    if (np.diff(ends) == dim).all():
        return values[ends[0] : ends[-1]].reshape(-1, dim).copy() if dim else m
    for r, (a, b) in enumerate(zip(ends, ends[1:])):
        m[r, : b - a] = values[a:b]
    return m


class Index(NamedTuple):
    """Written blocks of all rows; broadcast: the tree's ranges, and labels and vectors of the sample; slots by leaf; the vectors' length."""

    blocks: DataFrame
    ranges: object
    sample: object
    slots: dict[int, int]
    dim: int


def build_index(rows: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, ways: int = WAYS, block_rows: int = BLOCK_ROWS) -> Index | None:
    """The index of ``rows`` (vec_id long, label long, vector array<double>, is_anchor boolean), None if there are none."""
    spark = rows.sparkSession
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return None
    share = int((1 << 30) * min(1.0, sample / n))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) <= share).select("label", "vector").limit(2 * sample)
    held = list(drawn.toLocalIterator())
    fitted = np.array([[*r.vector, *[0.0] * (dim - len(r.vector))] for r in held]).reshape(len(held), dim)
    labels = np.array([r.label for r in held], np.int64)
    tree = Tree(fitted, max(8, leaf_rows * len(held) / n), ways)
    sent = spark.sparkContext.broadcast(tree)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, near = sent.value.locate(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), pa.array(near)], names=[*batch.schema.names, "leaf", "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number, leaf = sent.value, TaskContext.get().partitionId() << 30, None
        ids, labels, anchors, m = (np.zeros(0, np.int64),) * 3 + (np.zeros((0, dim)),)

        def made(leaf: int, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            uids = number * 4096 + np.arange(len(ids))
            norms = (m * m).sum(1)
            far = distances(m, p) if len(p := tree.points(leaf)) else np.zeros((len(m), 0))
            kind, raw = _pack(m)
            row = (leaf, number, len(ids), uids.tobytes(), ids.tobytes(), labels.tobytes(), kind, raw, norms.min(), norms.max(),
                   far.min(0).tolist(), far.max(0).tolist(), np.flatnonzero(anchors).astype(np.int64).tobytes())
            return _batch([row], _BLOCK)

        for batch in batches:
            leaves = batch.column("leaf").to_numpy()
            own = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label", "is_anchor")]
            vectors = _matrix(batch.column("vector"), dim)
            cuts = np.r_[0, np.flatnonzero(np.diff(leaves)) + 1, len(leaves)]
            for a, b in zip(cuts, cuts[1:]):
                if len(ids) and leaves[a] != leaf:
                    yield made(leaf, ids, labels, anchors, m)
                    number, ids, labels, anchors, m = number + 1, ids[:0], labels[:0], anchors[:0], m[:0]
                leaf = int(leaves[a])
                ids, labels, anchors = (np.r_[x, y[a:b]] for x, y in zip((ids, labels, anchors), own))
                m = np.concatenate([m, vectors[a:b]])
                while len(ids) >= block_rows:
                    yield made(leaf, ids[:block_rows], labels[:block_rows], anchors[:block_rows], m[:block_rows])
                    number, ids, labels, anchors, m = number + 1, ids[block_rows:], labels[block_rows:], anchors[block_rows:], m[block_rows:]
        if len(ids):
            yield made(leaf, ids, labels, anchors, m)

    located = rows.mapInArrow(locate, "vec_id long, label long, vector array<double>, is_anchor boolean, leaf int, near double")
    order = ["leaf", "near", "vec_id", F.xxhash64("vector")]
    blocks = cut_lineage(located.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _BLOCK))

    # a row per leaf and split point on its way: bounded by the tree
    sizes = blocks.groupBy("leaf").agg(F.count(F.lit(1)).alias("blocks"), F.min("norm_low"), F.max("norm_high")).collect()
    spans = blocks.select("leaf", F.posexplode(F.arrays_zip("near", "far")).alias("at", "d"))
    near, far = {}, {}
    for r in spans.groupBy("leaf", "at").agg(F.min("d.near").alias("near"), F.max("d.far").alias("far")).orderBy("leaf", "at").toLocalIterator():
        near.setdefault(r.leaf, []).append(r.near)
        far.setdefault(r.leaf, []).append(r.far)
    leaves = {leaf: (low, high, np.array(near.get(leaf, [])), np.array(far.get(leaf, []))) for leaf, _, low, high in sizes}
    slots = {leaf: -(-n // SLOT_BLOCKS) for leaf, n, _, _ in sizes}
    return Index(blocks, spark.sparkContext.broadcast(Ranges(tree, leaves)), spark.sparkContext.broadcast((labels, fitted)), slots, dim)


def index_anchors(index: Index) -> DataFrame:
    """uid, anchor_id, label, vector (packed, with its kind) of every anchor."""
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                vectors = _unpack(b["kind"], b["vectors"], dim)
                for k in _longs(b["anchors"]):
                    rows.append((_longs(b["uids"])[k], _longs(b["ids"])[k], _longs(b["labels"])[k], *_pack(vectors[k : k + 1])))
            if rows:
                yield _batch(rows, ddl)

    ddl = "uid long, anchor_id long, label long, kind int, vector binary"
    held = index.blocks.where(F.length("anchors") > 0)
    return held.select("uids", "ids", "labels", "kind", "vectors", "anchors").mapInArrow(run, ddl)


def raised(lows: np.ndarray, highs: np.ndarray, a: np.ndarray, label: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int, same: bool) -> np.ndarray:
    """``lows`` raised, per anchor and window, to the score that k rows of the sample reach in the window.

    Of the same label one more row has to reach it, as the anchor may be one of the sample.
    """
    labels, m = sample
    k += same
    if len(m) < k:
        return lows
    scores, out = dot(a, m), lows.copy()
    fits = (label[:, None] == labels) == same
    for w in range(lows.shape[1]):
        inside = fits & (scores >= lows[:, w, None]) & (scores <= highs[:, w, None])
        reached = np.partition(np.where(inside, scores, LOWEST), len(m) - k, axis=1)[:, len(m) - k]
        out[:, w] = np.maximum(out[:, w], reached)
    return out


def window_search(index: Index, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """uid, window, found_uid, found_id, score: the first k rows of every window of every anchor.

    ``asked``: uid, label, kind, vector, lows, highs (arrays of longs, one for
    each window; a window with a low above its high is empty).  Rows of the same
    label are looked at, or those of others.
    """
    ranges, sample, slots, dim = index.ranges, index.sample, index.slots, index.dim

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, labels = (batch.column(c).to_numpy() for c in ("uid", "label"))
            m = np.concatenate([_unpack(kind, raw, dim) for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("vector").to_pylist())])
            lows, highs = batch.column("lows").to_pylist(), batch.column("highs").to_pylist()
            width = max(map(len, lows))
            low, high = np.full((len(lows), width), 1), np.zeros((len(lows), width), np.int64)  # empty windows
            for r, (a, b) in enumerate(zip(lows, highs)):
                low[r, : len(a)], high[r, : len(b)] = a, b
            for at in range(0, len(uids), PACK):
                own = slice(at, at + PACK)
                u, c, v, h = uids[own], labels[own], m[own], high[own]
                x = raised(low[own], h, v, c, sample.value, k, same)
                for leaf, w in ranges.value.survivors(v, x, h):
                    if n := slots.get(leaf, 0) if len(w) else 0:
                        row = (u[w].tobytes(), b"", c[w].tobytes(), *_pack(v[w]), x[w].tobytes(), h[w].tobytes())
                        yield _batch([(leaf, slot, 1, *row) for slot in range(n)], _SENT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = [b % slots[leaf] for leaf, b in zip(batch.column("leaf").to_pylist(), batch.column("block").to_pylist())]
            none, empty = pa.array([0] * len(slot), pa.int32()), pa.array([b""] * len(slot), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("leaf"), pa.array(slot, pa.int32()), none, *(batch.column(c) for c in ("uids", "ids", "labels", "kind", "vectors")), empty, empty],
                names=[f.split(" ")[0] for f in _SENT.split(", ")],
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                leaf, slot, side, uids, ids, labels, kind, vectors, lows, highs = (c[r].as_py() for c in batch.columns)
                if (leaf, slot) != key:
                    key, blocks = (leaf, slot), []
                if side == 0:
                    m = _unpack(kind, vectors, dim)
                    blocks.append((_longs(uids), _longs(ids), _longs(labels), m, *_span(m, ranges.value.tree.points(leaf))))
                    continue
                own, label, a = _longs(uids), _longs(labels), _unpack(kind, vectors, dim)
                low, high = _longs(lows).reshape(len(own), -1), _longs(highs).reshape(len(own), -1)
                points = ranges.value.tree.points(leaf)
                found = [x for block in blocks if (x := _search_block(block, own, label, a, low, high, k, same, points))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _first(found, k)], names=["uid", "window", "found_uid", "found_id", "score"])

    asked = asked.select("uid", "label", "kind", "vector", "lows", "highs")
    rows = index.blocks.select("leaf", "block", "uids", "ids", "labels", "kind", "vectors").mapInArrow(deal, _SENT)
    both = rows.unionByName(asked.mapInArrow(send, _SENT)).repartition("leaf", "slot").sortWithinPartitions("leaf", "slot", "side")
    found = both.mapInArrow(search, "uid long, window int, found_uid long, found_id long, score long")
    first = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "found_id", "found_uid")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def _first(found: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """Of the columns of several blocks, the first k rows of each anchor and window."""
    if len(found) == 1:
        return found[0]
    uid, window, other, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((other, ids, ~score, window, uid))  # ~score: downwards, without an overflow
    new = np.r_[True, (np.diff(uid[order]) != 0) | (np.diff(window[order]) != 0)]
    start = np.flatnonzero(new)
    order = order[np.arange(len(order)) - start[np.cumsum(new) - 1] < k]
    return [x[order] for x in (uid, window, other, ids, score)]


def _span(m: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    norms = (m * m).sum(1)
    far = distances(m, points) if len(points) else np.zeros((len(m), 0))
    return far.min(0)[:, None], far.max(0)[:, None], np.array([[norms.min(), norms.max()]])


def _search_block(block: tuple, own: np.ndarray, label: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, points: np.ndarray) -> list[np.ndarray] | None:
    """Columns uid, window, found_uid, found_id, score of one block, or None; anchors that the block's own ranges rule out are not compared."""
    uids, ids, labels, m, near, far, norms = block
    if len(points):
        bounds = reach(distances(a, points), near, far)
    else:
        bounds = np.zeros((len(a), 1)), np.full((len(a), 1), np.inf)
    square = (a * a).sum(1)
    open_ = np.stack([meets(square, low[:, w], high[:, w], *bounds, norms)[:, 0] for w in range(low.shape[1])], 1)
    who = np.flatnonzero(open_.any(1))
    if not len(who):
        return None
    scores = dot(a[who], m)
    fits = (label[who][:, None] == labels) == same
    if same:
        fits &= own[who][:, None] != uids
    out = []
    for w in range(low.shape[1]):
        row, column = best(scores, fits & (scores >= low[who, w][:, None]) & (scores <= high[who, w][:, None]), ids, uids, k)
        if len(row):
            out.append([own[who[row]], np.full(len(row), w, np.int32), uids[column], ids[column], scores[row, column]])
    return [np.concatenate(x) for x in zip(*out)] if out else None


def mine_hard_negatives(
    table: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
    vec_id: str = "vec_id", label: str = "label", vector: str = "vector", **fit: int,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says which rows are anchors; their positives are the
    ``n_positives`` rows of the same label with the highest scores, and for each
    the first ``n_negatives`` rows of other labels whose scores are between
    ``low`` and ``high`` percent of the positive's.
    """
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & v.isNotNull() & finite).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
        v.cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    )
    index = build_index(rows, **fit)
    if index is None:
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asked = index_anchors(index)
    near = asked.withColumns({"lows": F.array(F.lit(LOWEST)), "highs": F.array(F.lit(HIGHEST))})
    positives = cut_lineage(
        window_search(index, near, n_positives, same=True).select("uid", (F.col("place") - 1).alias("window"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    windows = asked.join(_windows(positives, low, high), "uid")
    found = window_search(index, windows, n_negatives, same=False)
    return found.join(positives, ["uid", "window"]).join(asked.select("uid", "anchor_id"), "uid").select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _windows(positives: DataFrame, low: int, high: int) -> DataFrame:
    """uid, lows, highs: the scores that are between low and high percent of each positive's, as whole numbers."""
    score = F.col("positive_score").cast("decimal(24,0)")
    ends = positives.select(
        "uid", "window",
        F.ceil(score * low / 100).cast("decimal(38,0)").alias("low"), F.floor(score * high / 100).cast("decimal(38,0)").alias("high"),
    )
    inside = [F.least(F.greatest(F.col(c), F.lit(LOWEST)), F.lit(HIGHEST)).cast("long").alias(c) for c in ("low", "high")]
    held = ends.select("uid", "window", *inside).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("window", "low", "high"))).alias("w"))
    return held.select("uid", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
