import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from covlattice.llm import negatives, queries

from .conftest import EXTRA

SCHEMA = "vec_id long, label long, vector array<double>"


def brute(rows, is_anchor, n_positives=5, n_negatives=3, low=50, high=95):
    ok = [(i, c, v) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, _, v in ok), default=0)
    full = [[int(x) for x in v] + [0] * (dim - len(v)) for _, _, v in ok]
    out = []
    for a, (i, c, _) in enumerate(ok):
        if not is_anchor(i):
            continue
        score = [sum(x * y for x, y in zip(full[a], f)) for f in full]
        order = sorted((x for x in range(len(ok)) if x != a), key=lambda x: (-score[x], ok[x][0]))
        for p in [x for x in order if ok[x][1] == c][:n_positives]:
            fit = [x for x in order if ok[x][1] != c and low * score[p] <= 100 * score[x] <= high * score[p]]
            out += [(i, ok[p][0], r, ok[x][0], score[p], score[x]) for r, x in enumerate(fit[:n_negatives], 1)]
    return sorted(out)


def clustered(n, dim, seed, labels=4, spread=40, centers=12):
    r = np.random.default_rng(seed)
    base = r.normal(0, 60, (centers, dim))
    which = r.integers(0, centers, n)
    m = np.floor(base[which] + r.normal(0, spread, (n, dim)))
    return [(int(i), int(which[i] % labels if r.random() < 0.7 else r.integers(0, labels)), m[i].tolist()) for i in range(n)]


def mined(spark, rows, every=10, **fit):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(i).alias(c) for i, c in enumerate([*EXTRA, "uid", "leaf", "near", "is_anchor"])])
    return sorted(map(tuple, negatives.mine_hard_negatives(table, F.col("vec_id") % every == 0, **fit).collect()))


@pytest.mark.parametrize("fit", [{}, {"leaf_rows": 8, "ways": 4, "block_rows": 8, "sample": 150}])
def test_mining_is_that_of_brute_force(spark, fit):
    rows = clustered(400, 8, 1)
    r = random.Random(2)
    rows += [(1000 + k, 1, [float(x) for x in rows[7][2]]) for k in range(60)]  # copies
    rows += [(1100 + k, k % 3, [float(r.randrange(-1, 2)) for _ in range(8)]) for k in range(60)]  # ties
    rows += [(2000, None, [1.0] * 8), (2010, 1, None), (2020, 1, [1.0, None] + [0.0] * 6), (2030, 1, [float("nan")] * 8), (2040, 1, [float("inf")] * 8),
             (2050, 2, []), (2060, 1, [3.0]), (2070, 9, [50.0] * 8), (None, 1, [9.0] * 8), (10, 1, [70.0] * 8), (10, 1, [70.0] * 8), (-20, 0, [1.0] * 8)]
    assert mined(spark, rows, **fit) == brute(rows, lambda i: i % 10 == 0)


def test_scores_beyond_doubles_are_exact(spark):
    r = random.Random(3)
    rows = [(k, k % 3, [float(r.randrange(2**30, 2**30 + 5)) for _ in range(3)]) for k in range(40)]
    assert mined(spark, rows, leaf_rows=4, ways=3, block_rows=4) == brute(rows, lambda i: i % 10 == 0)


def test_every_row_is_a_leafs_and_dropped_leaves_hold_no_match(spark):
    rows = clustered(600, 4, 5, spread=6)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("is_anchor", F.col("vec_id") % 20 == 0)
    index = negatives.build_index(table, leaf_rows=16, ways=5, block_rows=16)
    blocks = index.blocks.collect()
    ids = sorted(np.concatenate([negatives._longs(b.ids) for b in blocks]).tolist())
    assert ids == list(range(600)) and len({b.leaf for b in blocks}) > 10 and max(b.n for b in blocks) <= 16
    m = np.array([v for _, _, v in rows])
    leaf = np.zeros(600, int)
    for b in blocks:
        leaf[negatives._longs(b.ids)] = b.leaf
    a = m[::20]
    scores = a @ m.T
    lows = np.quantile(scores, 0.97, axis=1).astype(np.int64)[:, None]
    highs = np.quantile(scores, 0.99, axis=1).astype(np.int64)[:, None]
    left = {(x, int(w)) for x, who in index.ranges.value.survivors(a, lows, highs) for w in who}
    need = {(int(leaf[j]), i) for i, j in zip(*np.nonzero((scores >= lows) & (scores <= highs)))}
    assert need <= left and len(left) < 0.6 * len(a) * len({b.leaf for b in blocks})


def test_best_takes_ties_by_id():
    scores = np.array([[5, 7, 7, 7, 1, 7, 0, 0, 0, 0, 0, 0, 9]])
    ids = np.array([0, 9, 3, 8, 1, 2, 20, 21, 22, 23, 24, 25, 26])
    row, column = negatives.best(scores, scores < 9, ids, ids, 3)
    assert ids[column].tolist() == [2, 3, 8] and row.tolist() == [0, 0, 0]
    row, column = negatives.best(scores, np.zeros(scores.shape, bool), ids, ids, 3)
    assert not len(row)


def test_empty_table_and_table_without_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine_hard_negatives(empty, F.col("vec_id") % 2 == 0).count() == 0
    assert mined(spark, [(1, 1, [1.0]), (3, 2, [1.0])]) == []
    assert mined(spark, [(10, 1, [1.0])]) == []


def test_query_relabels_and_floors(spark):
    got = sorted(map(tuple, queries.op13_negatives(spark, "/root/testdata/sf0.001").collect()))
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, float)).tolist()) for r in table]
    assert got == brute(rows, lambda i: i % 50 == 0)
