"""Fixed points of rounds against one pass, one after the other."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from covlattice.operators import pairs, splits


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def one_pass(rows, quotas):
    """The pairs of a pass over the anchors: (module, anchor, candidate, stratum) of each."""
    lists = {}
    for m, a, c, s in rows:
        lists.setdefault((m, a), {}).setdefault(s, []).append(c)
    taken, out = set(), []
    for m, a in sorted(lists, key=lambda k: (k[0], md5("0", *k), k[1])):
        for s, q in quotas.items():
            for c in sorted(lists[m, a].get(s, []), key=lambda c: md5("0", s, a, c)):
                if q and (m, min(a, c), max(a, c)) not in taken:
                    taken.add((m, min(a, c), max(a, c)))
                    out.append((m, a, c, s))
                    q -= 1
    return sorted(out)


def strata(members, seed, pool=None):
    r = random.Random(seed)
    rows = []
    for m, n in enumerate(members):
        for a in range(n):
            others = [c for c in range(n) if c != a]
            rows += [(m, a, c, r.choice(["low", "low", "mid", "high"])) for c in (others if pool is None else r.sample(others, min(pool, len(others))))]
    return rows


@pytest.mark.parametrize("members, pool, quotas", [([2, 3, 9, 25, 1], None, {"low": 2, "mid": 1, "high": 1}), ([40], 6, {"low": 3, "mid": 3, "high": 3}), ([12], None, {"low": 50, "mid": 0, "high": 2})])
def test_pairs_are_those_of_one_pass(spark, members, pool, quotas):
    rows = strata(members, 5, pool)
    table = spark.createDataFrame(rows, "module int, anchor long, candidate long, stratum string").withColumn("similarity", F.lit(0.5))
    made = pairs.greedy_pairs(table, quotas).collect()
    got = sorted((x.module, x.anchor, x.sample_b if x.anchor == x.sample_a else x.sample_a, x.stratum) for x in made)
    assert got == one_pass(rows, quotas)
    # no pair twice, no quota exceeded, and none that could still be added
    chosen = {(x.module, x.sample_a, x.sample_b) for x in made}
    assert len(chosen) == len(made)
    filled = {}
    for m, a, _, s in got:
        filled[m, a, s] = filled.get((m, a, s), 0) + 1
    assert all(n <= quotas[s] for (_, _, s), n in filled.items())
    assert not [x for x in rows if filled.get((x[0], x[1], x[3]), 0) < quotas[x[3]] and (x[0], min(x[1:3]), max(x[1:3])) not in chosen]


def test_no_candidates_no_pairs(spark):
    empty = spark.createDataFrame([], "module int, anchor long, candidate long, stratum string, similarity double")
    assert pairs.greedy_pairs(empty).count() == 0


def split_by_one_pass(rows, fraction, seed=42):
    groups, left = {}, {}
    for t, m in rows:
        groups.setdefault(t, {}).setdefault(m, 0)
        groups[t][m] += 1
        left[m] = left.get(m, 0) + 1
    target, filled, chosen = max(1, int(len(rows) * fraction)), 0, set()
    for t in sorted(groups, key=lambda t: (md5(seed, t), t)):
        if filled >= target:
            break
        if all(left[m] > n for m, n in groups[t].items()):
            chosen.add(t)
            filled += sum(groups[t].values())
            for m, n in groups[t].items():
                left[m] -= n
    return {t: t in chosen for t in groups}


@pytest.mark.parametrize("seed, fraction", [(1, 0.1), (2, 0.5), (3, 0.95)])
def test_split_is_that_of_one_pass(spark, seed, fraction):
    """Many modules of few rows, so that many stimuli are passed over and later ones depend on it."""
    r = random.Random(seed)
    rows = [(r.randrange(120), r.choice([r.randrange(4), r.randrange(60)])) for _ in range(500)]
    made = splits.sequential_split(spark.createDataFrame(rows, "test_id long, module int"), fraction)
    got = {x.test_id: x.is_val for x in made.collect()}
    assert got == split_by_one_pass(rows, fraction) and any(got.values())


def test_split_that_cannot_be_made(spark):
    with pytest.raises(ValueError, match="no stimulus"):
        splits.sequential_split(spark.createDataFrame([(1, 1), (2, 2)], "test_id long, module int"))
    with pytest.raises(ValueError, match="no samples"):
        splits.sequential_split(spark.createDataFrame([], "test_id long, module int"))
