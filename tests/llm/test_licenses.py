import random
import re

import pytest

from covlattice.llm import common, licenses

from .conftest import SCHEMA, prose


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def brute(text):
    own = words(text)
    h = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    found = []
    for name, t in licenses.TEMPLATES.items():
        w = words(t)
        have = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        width = 1
        while len(have) > 1 and width < len(have) * 4 / 3:
            width *= 2
        stride = max(1, width // 4)
        if any(len(have & set(h[i : i + width])) >= 0.8 * len(have) for i in range(0, len(h), stride)):
            found.append(name)
    return sorted(found)


@pytest.fixture(scope="module")
def licensed(spark, cases):
    rows = list(cases)
    for k, (name, t) in enumerate(sorted(licenses.TEMPLATES.items())):
        rows.append((100 + k, f"{prose(40, k)} {t} {prose(30, k + 1)}"))
        rows.append((200 + k, t.upper()))
        rows.append((300 + k, " ".join(t.split()[:3] + ["other"] + t.split()[4:])))
        rows.append((400 + k, t.replace(".", " ").replace("3", "2")))
    return rows


def test_report_is_that_of_brute_force(spark, licensed):
    got = licenses.license_report(spark.createDataFrame(licensed, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.licenses) for r in got), key=str) == sorted(((i, ",".join(brute(t))) for i, t in licensed), key=str)
    assert all(r.n_licenses == len([x for x in r.licenses.split(",") if x]) for r in got)


def test_shuffled_joins_and_full_filters_give_the_same(spark, licensed, monkeypatch):
    few = spark.createDataFrame([x for x in licensed[:30] if len(x[1] or "") < 2000], SCHEMA)
    want = sorted(map(tuple, licenses.license_report(few).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(licenses, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(licenses, "FILTER_BITS", 64)
    assert sorted(map(tuple, licenses.license_report(few).collect()), key=str) == want


def test_many_templates(spark):
    """Seven hundred templates of different lengths, each found where it stands and nowhere else; one is near another."""
    r = random.Random(8)
    templates = {f"t{k:03d}": " ".join(f"w{r.randrange(4000)}" for _ in range(5 + k % 60)) for k in range(700)}
    templates["t-long"] = " ".join(f"v{r.randrange(4000)}" for _ in range(3000))
    names = sorted(templates)
    rows = [(k, f"{prose(r.randrange(30), k)} {templates[n]} {prose(20, k + 1)}") for k, n in enumerate(names)]
    rows += [(2000 + k, " ".join(templates[n] for n in names[k * 50 : k * 50 + 50])) for k in range(4)] + [(3000, prose(300, 4))]
    got = {i: t.split(",") for i, _, t in map(tuple, licenses.license_report(spark.createDataFrame(rows, SCHEMA), templates).collect())}
    assert all(n in got[k] for k, n in enumerate(names)) and got[3000] == [""]
    assert all(set(names[k * 50 : k * 50 + 50]) <= set(got[2000 + k]) for k in range(4))
    assert sum(len(got[k]) for k in range(len(names))) == len(names)


def test_long_documents_are_cut_into_segments(spark, monkeypatch):
    """A notice at every place around the end of a segment is found."""
    monkeypatch.setattr(licenses, "SEGMENT", 64)
    notice = licenses.TEMPLATES["mit-permission"]
    rows = [(k, f"{' '.join(f'x{i}' for i in range(k))} {notice} {prose(200, 3)}") for k in range(0, 140, 3)]
    got = licenses.license_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.licenses for r in got} == {"mit-permission"}


def test_extra_columns_empty_table_and_short_template(docs, empty):
    assert licenses.license_report(docs).count() == docs.count()
    assert licenses.license_report(empty).count() == 0
    with pytest.raises(ValueError, match="fewer than 5 words"):
        licenses.license_report(empty, {"short": "MIT License"})
