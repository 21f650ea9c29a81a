import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from covlattice.llm import common, urls

DATA = "/root/testdata/sf0.1"

URLS = [
    "http://A.Example.com/de/x?q=1", "https://example.com/den/", "http://notexample.com/de/", "ftp://x.net", "http://x.net/", "https://m.example.net/en/1",
    "https://m.example.net/en", "http://a.org/fr/#f", "http://a.org?x=/fr/", "no scheme", "", None, "://host/path", "http://ÄB.net/ü", "http://h.com#a://b.net/",
    "http://x.net/", "http://u@x.net:80/en/",
]


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.host + r.path), default=None)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_hosts_paths_and_rules(spark, labels):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("tokens", F.lit(2))
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(pages, labels).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = brute(u)
        assert got[i] == (host, path, rule and rule.host + rule.path, rule.verdict if rule else "allow")


def test_mined_rules_block_what_labels_show(spark):
    rows = [(i, f"http://{'pills' if i % 3 == 0 else 'good'}{'.shop' if i % 2 else ''}.com/{'buy' if i % 5 == 0 else 'read'}/{i}") for i in range(600)]
    pages = spark.createDataFrame(rows + [(900, "http://pills.com/other"), (901, "http://good.com/buy/1"), (None, "http://pills.com/x")], "page_id long, url string")
    marks = spark.createDataFrame([(i, 1, 1 if i % 3 == 0 else 0) for i in range(500)] + [(3, 1, 1), (None, 0, None)], "doc_id long, quality int, toxic int")
    got = urls.judge_urls(pages, marks)
    blocked = {r.page_id for r in got.where("verdict = 'block'").collect()}
    assert blocked == {i for i in range(0, 600, 3)} | {900, None}
    assert got.count() == pages.count()


def test_pruning(spark):
    rows = [(["a", "b"], True)] * 50 + [(["a", "c"], True)] * 50 + [(["d"], False)] * 100 + [(["e"], True)] * 2
    rules, _ = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), support=0.05, confidence=0.9, least=5)
    assert {tuple(r.tokens) for r in rules.collect()} == {("a",), ("b",), ("c",)}


def test_empty_tables(spark, labels):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), labels).count() == 0


def tokens_of(url):
    host, path, _ = brute(url)
    labels = ["h:" + t for t in re.split(r"[.:@]+", host) if t]
    parts = ["p:" + (re.sub(r"^\d+$", "0", t)) for t in re.split(r"[\W_]+", path.lower()) if t]
    return list(dict.fromkeys(labels + parts))


def mined_by_brute_force(rows):
    """Minimal rules of (tokens, bad) rows: combinations of every URL's tokens, in rising length, none merged or left out but beyond a rule."""
    base = sum(b for _, b in rows) / len(rows)
    wanted, rules = min(1, max(urls.CONFIDENCE, urls.LIFT * base)), set()
    where = {}
    for k, (tokens, _) in enumerate(rows):
        for t in set(tokens):
            where.setdefault(t, set()).add(k)
    bad = {k for k, (_, b) in enumerate(rows) if b}
    level = {frozenset([t]): ks for t, ks in where.items()}
    while level:
        found = {c for c, ks in level.items() if len(ks & bad) >= urls.LEAST_URLS and len(ks & bad) / len(ks) >= wanted}
        rules |= found
        level = {c: ks for c, ks in level.items() if c not in found and len(ks & bad) >= urls.LEAST_URLS}
        parts = sorted({t for c in level for t in c})
        level = {c | {t}: ks & where[t] for c, ks in level.items() for t in parts if t > max(c)}
        level = {c: ks for c, ks in level.items() if not any(r <= c for r in rules)}
    return {tuple(sorted(r)) for r in rules}


def combinations_needed(rows):
    """Combinations that baskets can hold, by the definition of ``enough_urls``, at the least number of URLs."""
    bad = [r for r in rows if r[1]]
    n_bad = Counter(t for tokens, _ in bad for t in set(tokens))
    n = Counter(t for tokens, _ in rows for t in set(tokens))
    return sum(2 ** sum(n_bad[t] >= urls.LEAST_URLS and n_bad[t] / n[t] < urls.CONFIDENCE for t in set(tokens)) for tokens, _ in rows) / urls.LEAST_URLS


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_query_gives_what_brute_force_mines(spark):
    from covlattice.llm.queries import op4_urls

    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    bad = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    labelled = [(tokens_of(u), bad[i]) for i, u in pages if i in bad]
    assert combinations_needed(labelled) <= urls.COMBINATIONS
    rules = mined_by_brute_force(labelled)
    assert rules
    want, mined = [], 0
    for i, u in pages:
        host, path, rule = brute(u)
        matched = any(set(r) <= set(tokens_of(u)) for r in rules)
        mined += rule is None and matched
        want.append((i, host, path, rule and rule.host + rule.path, rule.verdict if rule else "block" if matched else "allow"))
    assert mined and sorted(map(tuple, op4_urls(spark, DATA).collect())) == sorted(want)


def test_long_and_repeated_urls(spark):
    """Equal URLs of very many tokens, and different ones of many shared tokens, give few combinations."""
    long = "http://bad.com/" + "/".join(f"part{k}x" for k in range(3000))
    rows = [(i, long) for i in range(20)]
    rows += [(100 + i, "http://worse.com/" + "/".join(f"piece{k}" for k in range(60) if (i * 7 + k * k) % 3)) for i in range(60)]
    rows += [(300 + i, f"http://good.com/{'x' * 100_000}/q{i}") for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame([(i, 1, int(i < 300)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, marks).collect()}
    assert got == {i: "block" if i < 300 else "allow" for i, _ in rows}


def verdicts(spark, labelled, others=()):
    """(verdicts of Spark, of brute force) on URLs made of (tokens, bad) rows and of other token lists."""
    made = [f"http://a.com/{'/'.join(tokens)}" for tokens, _ in labelled] + [f"http://a.com/{'/'.join(tokens)}" for tokens in others]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    marks = spark.createDataFrame([(i, 1, int(b)) for i, (_, b) in enumerate(labelled)], "doc_id long, quality int, toxic int")
    rules = mined_by_brute_force([(tokens_of(u), b) for u, (_, b) in zip(made, labelled)])
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, marks, rules=[]).collect()}
    want = {i: "block" if any(set(r) <= set(tokens_of(u)) for r in rules) else "allow" for i, u in enumerate(made)}
    return got, want, rules


def test_urls_of_forty_tokens(spark):
    """No token is left out, however many a URL has: single rules, rules of several tokens, tokens that only some have."""
    r = random.Random(6)
    rows = []
    for k in range(300):
        bad = r.random() < 0.3
        tokens = [f"t{x}" for x in range(60) if r.random() < (0.7 if bad == (x % 3 == 0) else 0.05)]
        tokens += [f"u{x}" for x in range(4) if r.random() < 0.5]
        if bad and r.random() < 0.6:
            tokens += ["left", "right"]
        elif r.random() < 0.5:
            tokens.append(r.choice(["left", "right"]))
        rows.append((tokens + [f"own{k}x{j}" for j in range(18)], bad))
    assert sum(len(t) for t, _ in rows) / len(rows) > 33
    others = [["left", "right"], ["left"], ["right", "u1"], ["t0"], ["t1", "u2"]]
    got, want, rules = verdicts(spark, rows, others)
    assert ("p:left", "p:right") in rules and any(len(x) == 1 for x in rules)
    assert got == want


def test_long_baskets_give_no_false_rule(spark):
    """Good URLs that hold a token beside many worse ones count against it."""
    worse = [f"w{k}" for k in range(12)]
    rows = [(worse, True)] * 43 + [(worse + ["z"], False)] * 30 + [(worse, False)] * 27 + [(["z"], True)] * 10 + [(["x"], False)] * 200
    got, want, rules = verdicts(spark, rows)
    assert not any("p:z" in x for x in rules) and got == want


def test_dense_baskets_take_little_time(spark):
    """Twelve tokens in every mixture, none of them a rule: the number of URLs a combination needs rises instead."""
    r = random.Random(7)
    rows = [([f"w{k}" for k in range(12) if r.random() < 0.9], r.random() < 0.43) for _ in range(416)] + [(["x"], False)] * 600
    labelled = spark.createDataFrame([(t, b) for t, b in rows], "tokens array<string>, bad boolean")
    urls.mine_rules(labelled)[0].count()  # compiled
    began = time.perf_counter()
    rules, _ = urls.mine_rules(labelled)
    found = {(tuple(x.tokens)): x.confidence for x in rules.collect()}
    assert time.perf_counter() - began < 20
    for tokens, confidence in found.items():
        has = [b for t, b in rows if set(tokens) <= set(t)]
        assert confidence == sum(has) / len(has) >= 0.5


def test_tokens_of_one_name_all_count(spark):
    """Alike tokens of the labelled URLs are told apart on others: each of them stands for the name."""
    rows = [(["a1", "a2", "b1", "b2"], True)] * 20 + [(["a1", "a2"], False)] * 30 + [(["b1", "b2"], False)] * 30
    got, want, rules = verdicts(spark, rows, [["a1", "b1"], ["a2", "b1"], ["a2", "b2"], ["a1", "a2"], ["b2"]])
    assert ("p:a2", "p:b1") in rules and got == want


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    test_tokens_of_one_name_all_count(spark)
    test_mined_rules_block_what_labels_show(spark)


def mixtures():
    """Twelve tokens in most mixtures: more combinations than are listed; two rare rules of several tokens."""
    r = random.Random(7)
    rows = [([f"w{k}" for k in range(12) if r.random() < 0.9], r.random() < 0.43) for _ in range(416)] + [(["x"], False)] * 600
    rows += [(["left", "right"], True)] * 7 + [(["left", "w1"], False)] * 20 + [(["right", "w2"], False)] * 20
    return rows


def minimal(rules):
    return {r for r in rules if not any(set(q) < set(r) for q in rules)}


@pytest.mark.parametrize("searched", [1 << 18, 40])
def test_no_rule_is_lost_where_combinations_are_many(spark, monkeypatch, searched):
    """Rules of few bad URLs are found beside more combinations than FP-growth may list."""
    monkeypatch.setattr(urls, "SEARCHED", searched)
    rows = mixtures()
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    rules, _ = urls.mine_rules(labelled, combinations=64)
    got = {tuple(sorted(x.tokens)): (x.n, x.confidence) for x in rules.collect()}
    want = mined_by_brute_force(rows)
    assert ("left", "right") in got and any(len(t) > 2 for t in got)
    assert set(got) == minimal(want)
    for tokens, (n, confidence) in got.items():
        has = [b for t, b in rows if set(tokens) <= set(t)]
        assert (n, confidence) == (len(has), sum(has) / len(has))


def test_rules_do_not_change_with_what_is_listed(spark):
    r = random.Random(3)
    rows = [([f"t{x}" for x in range(14) if r.random() < 0.5], r.random() < 0.3) for _ in range(250)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    few, all_ = ({(tuple(x.tokens), x.n) for x in urls.mine_rules(labelled, combinations=c)[0].collect()} for c in (16, 1 << 30))
    assert few == all_ and len(all_) > 3
