import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from covlattice.llm import common, interactions

from .conftest import EXTRA, prose

SCHEMA = "doc_id long, text string, source string"


def verdicts(rows):
    """The letters that every row fails, by the words of the task."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        })
    return out


def brute(rows, labels):
    fails = verdicts(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = []
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                removed_in_all[x] += len(gone)
                all_failing = sum(f[x] for _, f in own)
                alone = sum(f[x] and sum(f.values()) == 1 for _, f in own)
                found.append((part, "".join(order), step, len(left), len(gone), all_failing - len(gone), alone,
                              sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*x, removed_in_all[x[1][x[2] - 1]]) for x in found]
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(3)
    texts = [prose(210, 1), prose(250, 2) + " #1", "SHOUT " * 300, prose(260, 4).upper(), "word " * 400, "", None, "x", "ÀÉ | é", prose(230, 5) + "\x1c\xa0"]
    rows = [(i, r.choice(texts) if r.random() < 0.7 else prose(r.randrange(1, 400), i), r.choice(["web", "web", "web", "news", None, ""])) for i in range(150)]
    rows += [(7, texts[0], "web"), (7, texts[0], "web"), (None, texts[0], "web"), (None, None, None), (2**60, "x", "far"), (-5, "x", "far")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (2**60, 1, 1), (999, 1, 1)]
    return rows, labels


def frames(spark, tables):
    rows, labels = tables
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).select("*", *[F.lit(i).alias(c) for i, c in enumerate([*EXTRA, "part", "lists", "digest", "first"]) if c != "part"])
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_is_that_of_brute_force(spark, tables):
    made = interactions.filter_audit(*frames(spark, tables))
    assert sorted(map(tuple, made.collect())) == brute(*tables)


def test_small_ranges_and_joins_by_shuffle_give_the_same(spark, tables, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    docs, labels = frames(spark, tables)
    rows = interactions.with_labels(interactions.filter_failures(docs), labels, 5)
    postings = interactions.posting_lists(rows, 7, range_rows=4).cache()
    assert postings.agg(F.max("n_rows"), F.sum("n_rows")).first()[:] == (4, len(tables[0]))
    assert postings.where(F.exists("postings", lambda p: F.array_sort(F.array_distinct(p)) != p)).count() == 0
    made = interactions.interaction_audit(interactions.cell_sizes(postings), "ABCDE")
    assert sorted(map(tuple, made.collect())) == brute(*tables)


def test_own_filters(spark, tables):
    docs, labels = frames(spark, tables)
    long = {"L": lambda text, words, n: n > 1000, "S": lambda text, words, n: n < 10}
    rows = interactions.filter_failures(docs, long, copies=None)
    audit = interactions.interaction_audit(interactions.cell_sizes(interactions.posting_lists(interactions.with_labels(rows, labels, 2), 4)), "LS")
    got = {(x.part, x.filter_order, x.step): x for x in audit.collect()}
    n = sum((s or "") == "web" for _, _, s in tables[0])
    short = sum((s or "") == "web" and len(t or "") < 10 for _, t, s in tables[0])
    assert got["web", "SL", 1].removed == got["web", "LS", 2].removed == short and got["web", "SL", 1].kept == n - short


def test_gallop_and_merge():
    ids = [1, 3, 5, 7, 9, 11, 13]
    for at in range(len(ids) + 1):
        for x in range(15):
            assert interactions.gallop(ids, at, x) == next((k for k in range(at, len(ids)) if ids[k] >= x), len(ids))
    r = random.Random(1)
    for _ in range(200):
        lists = [sorted(r.sample(range(40), r.randrange(0, 25))) for _ in range(r.randrange(1, 6))]
        want = {}
        for x in range(40):
            mask = sum(1 << k for k, ids in enumerate(lists) if x in ids)
            if mask:
                want[mask] = want.get(mask, 0) + 1
        assert dict(interactions.merge_cells(lists)) == want


def test_gallop_skips_long_stretches():
    class Counted(list):
        looks = 0

        def __getitem__(self, k):
            Counted.looks += 1
            return super().__getitem__(k)

    cells = interactions.merge_cells([Counted(range(100_000)), [50_000, 200_000]])
    assert cells == {1: 99_999, 2: 1, 3: 1} and Counted.looks < 100


def test_empty_tables(spark, tables):
    docs, labels = frames(spark, tables)
    assert interactions.filter_audit(docs.where("false"), labels).count() == 0
    no_labels = interactions.filter_audit(docs, labels.where("false"))
    assert no_labels.where("good_lost + toxic_lost > 0").count() == 0 and no_labels.count() == 600 * 4
