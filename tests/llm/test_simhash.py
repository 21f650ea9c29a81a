import random
import re

import numpy as np
import pytest
import xxhash

from covlattice.llm import common, components, simhash

from .conftest import SCHEMA, prose


def fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(fps, radius=4):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = classes(fps)
    smallest = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    return sorted(((i, f"{f:016x}", smallest.get(r)) for (i, _), f, r in zip(rows, fps, root)), key=str)


def test_report_is_that_of_brute_force(spark, docs, cases):
    assert sorted(map(tuple, simhash.near_duplicate_report(docs).collect()), key=str) == brute(cases)


def test_near_copies_chain(spark):
    base = prose(300, 9).split()
    rows = [(k, " ".join(base[:i] + ["new"] + base[i:])) for k, i in enumerate(range(0, 300, 12))] + [(100 + k, prose(200, 50 + k)) for k in range(40)]
    rows = [(i, t) for i, t in rows for _ in range(2)]
    made = sorted(map(tuple, simhash.near_duplicate_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert made == brute(rows)


def test_tiles_lose_no_link(spark):
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for f in list(fps):
        for n in (1, 4, 5):
            fps.append(f ^ sum(1 << b for b in r.sample(range(64), n)))
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = components.components(simhash.fingerprint_links(nodes, tile=8)).collect()
    root = {r.node: r.root for r in found}
    got = [root.get(f, f) for f in signed]
    want = classes(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_links_within_and_between_tiles():
    r = np.random.default_rng(5)
    near = r.integers(0, 2**63, 1, np.uint64) ^ np.uint64(1) * r.integers(0, 16, 300, np.uint64)
    far = r.integers(0, 2**63, 500, np.uint64)
    a, b = simhash.links_within(np.unique(np.r_[near, far]), None)
    assert 15 <= len(a) <= 800 and (np.bitwise_count(a ^ b) <= 64).all()
    x, y = simhash.links_within(near[:150], near[150:])
    assert len(x) >= 14


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(100, 100 + i) for i in range(1, 40)]
    odd = [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    made = components.components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()
    by = {}
    for r in made:
        by.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, by.values())) == sorted([list(range(51)), list(range(100, 140)), [200, 201]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [1, 30])
def test_joins_by_shuffle_give_the_same(spark, docs, cases, monkeypatch, hot):
    """With nothing broadcast but the hot fingerprints, and a fingerprint that a third of all rows have."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = cases + [(1000 + k, prose(60, 1)) for k in range(20)] + [(2000 + k, prose(60, 1) + " x" * (k % 3)) for k in range(20)]
    made = simhash.near_duplicate_report(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, made.collect()), key=str) == brute(rows)
    test_one_row_of_each_class_stays(spark, docs, cases)


def test_one_row_of_each_class_stays(spark, docs, cases):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    firsts = {c for _, _, c in brute(cases)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted(firsts | ({None} if any(i is None for i in got) else set()), key=str)
    assert kept.select("doc_id", "text").distinct().count() == len(got)


def test_empty_table(empty):
    assert simhash.near_duplicate_report(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("text, want", [("", 0), (None, 0), ("One", fingerprint("one"))])
def test_small_texts(text, want):
    got = simhash.simhash(text.encode() if text is not None else None)
    assert got & (1 << 64) - 1 == want
