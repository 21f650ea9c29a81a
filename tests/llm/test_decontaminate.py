import hashlib
import random
import re

import pytest

from covlattice.llm import decontaminate

from .conftest import SCHEMA

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, met = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    hit.update(range(s, s + n))
                    met |= found
        ids = sorted(str(x) for x in met if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark, cases):
    r = random.Random(6)
    word = lambda: r.choice(["alpha", "be", "c", "delta9", "é", "Ünder"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([25, 10, 11, 9, 3, 40, 12])]
    items += [(20, "One!"), (21, ""), (22, None), (None, items[0][1]), (23, items[0][1].upper()), (24, "#$%"), (25, items[2][1]), (25, items[2][1])]
    rows = list(cases)
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        rows.append((500 + k, " ".join(["before"] * 3 + w[1:] + ["after"] + w[:12])))
        rows.append((600 + k, ", ".join(w * 3)))
        rows.append((700 + k, " ".join(w[:9] + ["x"] + w[10:])))
    rows += [(800 + k, " ".join(word() for _ in range(300))) for k in range(20)]
    return rows, items, spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_report_is_that_of_brute_force(tables):
    rows, items, docs, bench = tables
    assert sorted(map(tuple, decontaminate.contamination_report(docs, bench).collect()), key=str) == brute(rows, items)


def test_every_run_keeps_a_hash(tables):
    spans = decontaminate.Spans([decontaminate.words_of(t and t.encode()) for _, t in tables[0]])
    kept, h = spans.winnowed(10, 5)
    for start in range(len(h)):
        if spans.left[start] >= 10:
            assert ((kept >= start) & (kept <= start + 5)).any()


def test_a_huge_document_goes_in_pieces(spark):
    cut = decontaminate.PIECE_WORDS - 9
    text = [f"w{i % 997}" for i in range(cut + 5000)]
    passage = [f"item{i}" for i in range(16)]
    for at in (100, cut - 14, cut + 4000):
        text[at : at + 16] = passage
    text[cut + 300 : cut + 302] = ["two", "words"]
    items = [(1, " ".join(passage)), (2, "two words")]
    rows = [(1, " ".join(text)), (2, " ".join(passage[:9]))]
    made = decontaminate.contamination_report(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, made.collect()), key=str) == brute(rows, items)
    assert {r.doc_id: r.n_hit for r in made.collect()} == {1: 50, 2: 0}


def test_equal_windows_keep_equal_hashes():
    w = [b"w%d" % (i % 17) for i in range(60)]
    one, other = decontaminate.Spans([w]), decontaminate.Spans([[b"x", b"y"] + w[5:30], [b"z"]])
    (a, ha), (b, hb) = one.winnowed(10, 5), other.winnowed(10, 5)
    for s in range(5, 20):
        mine = {int(ha[k]) for k in a if s <= k <= s + 5}
        theirs = {int(hb[k]) for k in b if s - 3 <= k <= s + 2}
        assert mine & theirs


def test_contaminated_rows_go(tables):
    rows, items, docs, bench = tables
    bad = {i for i, _, hit, *_ in brute(rows, items) if hit}
    kept = decontaminate.drop_contaminated(docs.withColumn("hits", docs.doc_id), bench)
    assert kept.columns == ["doc_id", "text", "hits"]
    clean = [i for i, t in rows if not brute([(i, t)], items)[0][5]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str) and bad


def test_extra_columns_and_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_report(docs, bench).count() == docs.count()
    assert decontaminate.contamination_report(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination_report(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()
