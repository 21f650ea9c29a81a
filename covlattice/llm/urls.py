"""URL filter: configured host rules, then association rules (native DataFrame expressions).

FP-growth mines the token combinations of labelled URLs that go with bad
labels.  A rule needs ``LEAST_URLS`` bad URLs and a share of ``SUPPORT`` of the
labelled ones, a share of ``CONFIDENCE`` bad URLs among all labelled URLs that
have its tokens, and ``LIFT`` times the share that all labelled URLs have; rules
that contain another are pruned.

Mining goes by length.  Tokens are counted first: those that are rules alone
leave the baskets, since every rule that holds one would be pruned, and so do
those that too few bad URLs have, since no rule can hold one.  Tokens of exactly
the same labelled URLs stand under one name in the baskets.  None of that changes
a count, so FP-growth on what is left finds exact confidences.  It lists every
frequent combination; where there could be more than ``COMBINATIONS`` of them, it
lists those of more bad URLs only, and :func:`rarer_rules` finds the rules of
fewer: it goes from the rarest token on and lists no combination, so that none is
lost either way.

Matching is by an inverted index: a URL's tokens that occur in rules are looked
up, each under its name (all tokens of a name count as it); single tokens block
at once, and a combination, filed under its rarest token, where the URL has all
of it.

Defined results: a null URL or one without ``://`` has an empty host and path,
no tokens and is allowed; repeated URLs get equal verdicts, one for each row; an
empty table gives no rules; without labels no rule is mined; columns other than
id and URL are not looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covlattice.llm.common import BROADCAST_ROWS, cut_lineage, left_join_skewed, small

#: Least share of the labelled URLs that have a rule's tokens and the bad label; it bounds the tokens that FP-growth ranks.
SUPPORT = 1e-5
#: Least number of such URLs.
LEAST_URLS = 5
#: Least share of bad labels among the URLs that have a rule's tokens.
CONFIDENCE = 0.5
#: The same as a multiple of the share among all labelled URLs.
LIFT = 2.0
#: Combinations of tokens that FP-growth may have to list; those of fewer bad URLs are searched, not listed.
COMBINATIONS = 1 << 18
#: Tokens of the baskets below a combination that one task searches; more of them are dealt by their next token first.
SEARCHED = 1 << 18
_BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    """Applies to ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


RULES = [
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """The longest rule that fits, written host + path, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the labels of the host, and the parts of the path with numbers made alike."""
    labels = F.transform(F.split(host, r"[.:@]+"), lambda t: F.concat(F.lit("h:"), t))
    parts = F.transform(
        F.split(F.lower(path), r"[^\p{L}\p{N}]+"),
        lambda t: F.concat(F.lit("p:"), F.regexp_replace(t, r"^\p{N}+$", "0")),
    )
    return F.array_distinct(F.filter(F.concat(labels, parts), lambda t: F.length(t) > 2))


class TokenCounts(NamedTuple):
    """Written tables of labelled URLs: (row, bad, token), and (token, n, n_bad, name) of tokens that enough bad ones have."""

    each: DataFrame
    tokens: DataFrame


def count_tokens(labelled: DataFrame, least: int) -> TokenCounts:
    """Counts of the tokens of ``labelled`` (tokens, bad); tokens of the same URLs share a ``name``, the first of them."""
    rows = cut_lineage(labelled.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    h = F.xxhash64("row")
    counts = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y")
    )
    enough = cut_lineage(counts.where(F.col("n_bad") >= least))
    names = enough.groupBy("n", "n_bad", "x", "y").agg(F.min("token").alias("name"))
    return TokenCounts(each, cut_lineage(enough.join(names, ["n", "n_bad", "x", "y"]).select("token", "n", "n_bad", "name")))


def baskets(counts: TokenCounts, mined: DataFrame) -> DataFrame:
    """(bad, items) of the labelled URLs that have tokens of ``mined`` (token, n, n_bad); items are structs (n_bad, token, n_good)."""
    known = cut_lineage(mined.select("token", "n", "n_bad", (F.col("n") - F.col("n_bad")).alias("n_good")))
    met = left_join_skewed(counts.each, known, "token").where("n_bad IS NOT NULL")
    items = F.collect_list(F.struct("n_bad", "token", "n_good")).alias("items")
    return cut_lineage(met.groupBy("row").agg(F.first("bad").alias("bad"), items).drop("row"))


def enough_urls(found: DataFrame, least: int, combinations: int = COMBINATIONS) -> int | None:
    """The least number of bad URLs, from ``least`` on, for which no more combinations than that can be as frequent.

    A combination lies in one of the different baskets, and in that many of all;
    a basket of k tokens holds 2^k.  None if ``found`` has single tokens only.
    """
    first = least
    while True:
        kept = F.array_sort(F.transform(F.filter("items", lambda x: x["n_bad"] >= least), lambda x: x["token"]))
        different = found.groupBy(kept.alias("t")).agg(F.count(F.lit(1)).alias("n"))
        holds = F.pow(F.lit(2.0), F.size("t"))
        most, in_all, longest = different.agg(F.sum(holds), F.sum(holds * F.col("n")), F.max(F.size("t"))).first()
        if (longest or 0) < 2 and least == first:
            return None
        if min(most or 0, (in_all or 0) / least) <= combinations:
            return least
        least += max(1, least // 2)


class _Below(NamedTuple):
    """Different baskets that hold a combination: the tokens that may follow it, one basket after the other, and their URLs."""

    tokens: np.ndarray
    row: np.ndarray
    good: np.ndarray
    bad: np.ndarray


def _grown(start: list[str], names: list[str], below: _Below, least: int, wanted: float) -> Iterator[tuple[list[str], int, int]]:
    """(tokens, n, n_bad) of the rules that continue ``start``, by depth: a rule is not continued.

    Tokens are numbered from the rarest among good URLs on.  One that all good
    URLs of a combination have is not added: without it, a rule that holds both
    has as many good URLs and no fewer bad ones, so it would be one already.
    """
    stack = [_opened(start, below, least, wanted)]
    yield from stack[0].rules(names)
    while stack:
        top = stack[-1]
        t = next(top.next_, None)
        if t is None:
            stack.pop()
            continue
        tokens, row, good, bad = top.below
        has = np.zeros(len(good), bool)
        has[row[tokens == t]] = True
        later = has[row] & (tokens > t)
        if later.any():
            place = np.cumsum(has) - 1
            down = _opened([*top.held, names[t]], _Below(tokens[later], place[row[later]], good[has], bad[has]), least, wanted)
            yield from down.rules(names)
            stack.append(down)


class _Opened(NamedTuple):
    """A combination with the rules of one token more, and the tokens that are still to be followed."""

    held: list[str]
    below: _Below
    next_: Iterator[int]
    found: list[tuple[int, int, int]]

    def rules(self, names: list[str]) -> Iterator[tuple[list[str], int, int]]:
        return (([*self.held, names[t]], n, n_bad) for t, n, n_bad in self.found)


def _opened(held: list[str], below: _Below, least: int, wanted: float) -> _Opened:
    tokens, row, good, bad = below
    kinds, at = np.unique(tokens, return_inverse=True)
    n_good, n_bad = (np.bincount(at, weights=w[row], minlength=len(kinds)) for w in (good, bad))
    open_ = (n_bad >= least) & (n_good < good.sum())
    rule = (n_bad >= least) & (n_bad / np.maximum(n_good + n_bad, 1) >= wanted)
    found = [(int(kinds[k]), int(n_good[k] + n_bad[k]), int(n_bad[k])) for k in np.flatnonzero(rule)]
    kept = (open_ & ~rule)[at]  # what holds a rule is pruned
    return _Opened(held, _Below(tokens[kept], row[kept], good, bad), iter(kinds[open_ & ~rule].tolist()), found)


def rarer_rules(found: DataFrame, least: int, below: int, wanted: float, searched: int | None = None) -> DataFrame:
    """(tokens, n, n_bad) of rules of several tokens that ``least`` bad URLs or more have, but fewer than ``below``.

    ``found`` has (bad, items).  Different baskets are counted and dealt by their
    tokens: to each goes what is rarer among the others.  Combinations below which
    more than ``searched`` tokens lie are dealt by the next token as well, and so
    on; the others are searched by depth, one at a time in a task.  The work grows
    with the combinations that the baskets share, the memory with ``searched``.
    Some rules may contain another.
    """
    searched = SEARCHED if searched is None else searched
    sorted_ = F.array_sort(F.transform("items", lambda x: F.struct(x["n_good"].alias("n_good"), x["token"].alias("token"))))
    tokens, rank = F.transform(sorted_, lambda x: x["token"]), F.transform(sorted_, lambda x: x["n_good"])
    open_ = found.groupBy(F.array().cast("array<string>").alias("held"), tokens.alias("rest"), rank.alias("rank")).agg(
        F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad")
    )
    rules, ready = None, []
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    while True:
        at = F.posexplode("rest").alias("k", "t")
        dealt = open_.select("held", "rest", "rank", "good", "bad", at)
        after = [F.slice(c, F.col("k") + 2, F.size(c)).alias(c) for c in ("rest", "rank")]
        dealt = dealt.select(F.concat("held", F.array("t")).alias("held"), *after, "good", "bad").groupBy("held", "rest", "rank")
        dealt = cut_lineage(dealt.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
        sums = dealt.groupBy("held").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.sum(F.size("rest")).alias("below"))
        sums = cut_lineage(sums.where(F.col("n_bad") >= least))
        is_rule = F.col("n_bad") / (F.col("n_good") + F.col("n_bad")) >= wanted
        made = sums.where(is_rule & (F.size("held") > 1)).select(F.col("held").alias("tokens"), (F.col("n_good") + F.col("n_bad")).alias("n"), "n_bad")
        rules = made if rules is None else rules.unionByName(made)
        going = sums.where(~is_rule & (F.col("below") > 0)).select("held", "below")
        met = dealt.join(going, "held")
        ready.append(met.where(F.col("below") <= searched).drop("below"))
        open_ = cut_lineage(met.where(F.col("below") > searched).drop("below"))
        if open_.isEmpty():
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, rows in _each_combination(batches):
            known = sorted({(r, t) for rest, rank, _, _ in rows for t, r in zip(rest, rank)})
            number = {t: k for k, (_, t) in enumerate(known)}
            sizes = [len(rest) for rest, *_ in rows]
            flat = np.array([number[t] for rest, *_ in rows for t in rest], np.int64)
            start = _Below(flat, np.repeat(np.arange(len(rows)), sizes), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
            out = []
            for rule in _grown(held, [t for _, t in known], start, least, wanted):
                out.append(rule)
                if len(out) == 1024:
                    yield _rule_rows(out)
                    out = []
            if out:
                yield _rule_rows(out)

    small_ones = functools.reduce(DataFrame.unionByName, ready)
    grouped = small_ones.withColumn("name", F.concat_ws("\0", "held")).repartition(parts, "name").sortWithinPartitions("name")
    deeper = grouped.select("name", "held", "rest", "rank", "good", "bad").mapInArrow(run, "tokens array<string>, n bigint, n_bad bigint")
    return rules.unionByName(deeper).where(F.col("n_bad") < below).withColumn("tokens", F.array_sort("tokens"))


def _each_combination(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[tuple]]]:
    """(held, [(rest, rank, good, bad)]) of each combination of sorted rows."""
    at, held, rows = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["name"] != at:
                if rows:
                    yield held, rows
                at, held, rows = row["name"], row["held"], []
            rows.append((row["rest"], row["rank"], row["good"], row["bad"]))
    if rows:
        yield held, rows


def _rule_rows(rules: list[tuple[list[str], int, int]]) -> pa.RecordBatch:
    tokens, n, n_bad = zip(*rules)
    return pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string())), pa.array(n, pa.int64()), pa.array(n_bad, pa.int64())], names=["tokens", "n", "n_bad"])


def mine_rules(
    labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_URLS, lift: float = LIFT,
    combinations: int = COMBINATIONS,
) -> tuple[DataFrame, DataFrame]:
    """``labelled`` (tokens, bad) to rules (tokens, confidence, support, n) that imply the bad label, and (token, name, n) of all counted tokens.

    ``tokens`` of a rule of several are names.
    """
    facts = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    n = facts["n"]
    least = max(least, math.ceil(support * n))
    wanted = min(1.0, max(confidence, lift * facts["bad"] / max(1, n)))
    counts = count_tokens(labelled, least)
    share = F.col("n_bad") / F.col("n")
    as_rule = [share.alias("confidence"), (F.col("n_bad") / n).alias("support"), "n"]
    rules = counts.tokens.where(share >= wanted).select(F.array("token").alias("tokens"), *as_rule)
    found = baskets(counts, counts.tokens.where((share < wanted) & (F.col("token") == F.col("name"))))
    needed = enough_urls(found, least, combinations)
    names = counts.tokens.select("token", "name", "n")
    if needed is None:
        return cut_lineage(rules), names
    tokens = F.transform(F.filter("items", lambda x: x["n_bad"] >= needed), lambda x: x["token"])
    items = cut_lineage(found.select(F.when(F.col("bad"), F.concat(tokens, F.array(F.lit(_BAD)))).otherwise(tokens).alias("items")))
    # half a URL less, so that the product of share and count can't round up to one more
    model = FPGrowth(itemsCol="items", minSupport=(needed - 0.5) / items.count()).fit(items)
    sets = cut_lineage(model.freqItemsets)
    with_label = sets.where(F.array_contains("items", _BAD) & (F.size("items") > 2)).select(
        F.array_sort(F.array_remove("items", _BAD)).alias("tokens"), F.col("freq").alias("n_bad")
    )
    all_urls = sets.where(~F.array_contains("items", _BAD)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    several = with_label.join(all_urls, "tokens").where((F.col("n_bad") >= needed) & (share >= wanted)).select("tokens", "n", "n_bad")
    if needed > least:
        several = several.unionByName(rarer_rules(found, least, needed, wanted))
    several = cut_lineage(several.select("tokens", *as_rule))
    frequency = counts.tokens.select("token", "n")
    covered = holding(several.select(F.col("tokens").alias("has")), rule_index(several, frequency), strict=True).select(F.col("has").alias("tokens"))
    return cut_lineage(rules.unionByName(several.join(covered.distinct(), "tokens", "left_anti"))), names


def rule_index(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """(token, tokens): each rule under the token that the fewest labelled URLs have."""
    rarest = (
        rules.select("tokens", F.explode("tokens").alias("token"))
        .join(frequency, "token", "left")
        .groupBy("tokens")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("k"))
    )
    return rarest.select(F.col("k.token").alias("token"), "tokens")


def holding(sets: DataFrame, index: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of ``sets`` (has, ...) that hold all tokens of a rule of ``index``, which is broadcast if it is small; ``strict``: and more."""
    looked = sets.withColumn("token", F.explode("has"))
    hits = looked.join(small(cut_lineage(index)), "token").where(F.size(F.array_except("tokens", "has")) == 0)
    return hits.where(F.size("has") > F.size("tokens")).drop("token", "tokens") if strict else hits.drop("token", "tokens")


def mined_blocks(urls: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct ``url_`` of ``urls`` (url_, tokens), one row each, that have all tokens of a rule."""
    several = cut_lineage(rules.where(F.size("tokens") > 1))
    parts = several.select(F.explode("tokens").alias("name")).distinct()
    single = rules.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"))
    needed = cut_lineage(
        single.select("token", F.lit(None).cast("string").alias("name")).unionByName(names.join(parts, "name").select("token", "name"))
    )
    looked = urls.select("url_", F.explode("tokens").alias("token"))
    if needed.count() > BROADCAST_ROWS:  # tokens that very many URLs have are met by broadcast all the same
        needed = cut_lineage(needed.join(looked.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token"))
        met = left_join_skewed(looked, needed.withColumn("met", F.lit(True)), "token").where("met")
    else:
        met = looked.join(F.broadcast(needed), "token")
    met = cut_lineage(met.select("url_", "name"))
    sets = met.where("name IS NOT NULL").groupBy("url_").agg(F.collect_set("name").alias("has"))
    both = holding(sets, rule_index(several, names.select("token", "n"))).select("url_")
    return met.where("name IS NULL").select("url_").unionByName(both).distinct()


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[UrlRule] = RULES,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    ``labels`` (doc_id, quality, toxic) label the page of the same id: bad if
    quality is 0 or toxic is 1; every labelled page is a basket.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    split = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url_"), host.alias("host"), path.alias("path")
    )
    name, verdict = match_rules(F.col("host"), F.col("path"), rules)
    split = cut_lineage(split.select("page_id", "url_", "host", "path", name.alias("rule"), verdict.alias("ruled")))
    tokens = url_tokens(F.col("host"), F.col("path")).alias("tokens")
    undecided = split.where("rule IS NULL").select("url_", tokens)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.select("doc_id", F.coalesce(bad, F.lit(False)).alias("bad")).groupBy("doc_id").agg(F.max("bad").alias("bad"))
    labelled = cut_lineage(
        split.join(marks, split["page_id"] == marks["doc_id"]).select(tokens, "bad")
    )
    if labelled.isEmpty():
        return split.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    distinct = undecided.groupBy("url_").agg(F.count(F.lit(1)).alias("n"), F.first("tokens").alias("tokens"))
    distinct = cut_lineage(distinct.where(F.size("tokens") > 0))
    blocked = mined_blocks(distinct, *mine_rules(labelled))
    blocked = cut_lineage(distinct.select("url_", "n").join(small(cut_lineage(blocked)), "url_").withColumn("mined", F.lit(True)))
    judged = left_join_skewed(split, blocked, "url_")
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("mined"), F.lit("block")), F.lit("allow")).alias("verdict"),
    )
