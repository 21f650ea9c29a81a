"""Quality rules as a short-circuit cascade (native DataFrame expressions).

Each rule is a boolean column that is true for a document to reject.  On a
bounded sample the cascade measures how long a rule takes, with the counts that
it needs, and how many rows it rejects, and puts the rules in the order of
rejections per cost; one ``CASE`` then tries them in that order, so a document
stops at the first rule that rejects it.  The order never changes the verdict,
only the work.

The sample is read from a few files, drawn by the hash of their names, and in
them rows are drawn by hash, so a plan costs no scan of the table.  One job then
tries all rules on it: every row is tried several times by every rule, between
two looks at the executor's clock, and its least time counts.

Defined results: a null text has no words and counts as the empty text; an
empty table gives no rows; equal rows get equal verdicts; columns beyond the
text are passed on, and the columns that the operator adds replace columns of
the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covlattice.llm.common import SPACES, bind

#: Words in a window of the repetition count; a power of two.
WINDOW = 8
#: Rows whose cost and selectivity are measured, about; they decide the order alone.
SAMPLE_ROWS = 400
#: Files that they are drawn from at most.
SAMPLE_FILES = 16
#: Longer texts are left out of that sample, so that it stays small.
SAMPLE_CHARS = 50_000
#: A row is tried so often by a rule, and the least time counts.
TIMES = 5
#: Rejections per second within this factor of the best of a group count as equal.
EQUAL = 1.3


class Rule(NamedTuple):
    """``rejects(doc)`` is true for documents that the rule turns away."""

    name: str
    rejects: Callable[[Column], Column]


class RuleStats(NamedTuple):
    name: str
    seconds: float
    rejected: float


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long")


def lines_of(text: Column) -> Column:
    """Lines that hold at least one word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(lines: Column) -> Column:
    """Lines equal to an earlier one."""
    return bind(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more.

    ``window`` is a power of two.  Windows are told apart by a 64-bit hash,
    each built from the hashes of its two halves.  Only documents with a repeated
    hash sort their windows: the starts of repeated windows, in order, each
    cover as many words as lie before the next such start, ``window`` at most.
    """

    def covered(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bind(
            tagged,
            lambda s: F.filter(
                s,
                lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]),
            ),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda a, i: F.struct(
                (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")
            ),
            lambda a: a["n"],
        )

    def hashes(ws: Column) -> Column:
        out, step = F.transform(ws, lambda w: F.xxhash64(w)), 1
        while step < window:
            out, step = bind(out, pairs_at(step)), 2 * step
        return out

    def pairs_at(step: int):
        return lambda h: F.zip_with(
            F.slice(h, F.lit(1), F.size(h) - step),
            F.slice(h, F.lit(1 + step), F.size(h) - step),
            lambda x, y: F.xxhash64(x, y),
        )

    def count(ws: Column) -> Column:
        return F.when(F.size(ws) <= window, F.lit(0)).otherwise(
            bind(
                hashes(ws),
                lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
            )
        )

    return bind(words, count).cast("long")


def letter_words(words: Column) -> Column:
    """Words with at least one letter."""
    return F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))


def upper_share(text: Column) -> Column:
    """Share of upper-case letters among all letters; 0 without letters."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", "")
    return bind(
        letters,
        lambda s: F.coalesce(
            F.try_divide(F.length(F.regexp_replace(s, r"\P{Lu}+", "")), F.length(s)), F.lit(0.0)
        ),
    )


#: Rules read a document as a struct; a field may be a count or a text.
BASE_RULES = [
    Rule("too_few_words", lambda d: d["n_words"] < 20),
    Rule("repeated_windows", lambda d: 100 * d["n_repeat_words"] > 30 * d["n_words"]),
]

#: Published heuristics for web text; a text without words is left to the base rules.
CONTENT_RULES = [
    Rule("symbols", lambda d: 10 * d["n_symbols"] > d["n_words"]),
    Rule(
        "word_length",
        lambda d: (d["n_words"] > 0) & ~d["word_chars"].between(3 * d["n_words"], 10 * d["n_words"]),
    ),
    Rule("few_letter_words", lambda d: 100 * letter_words(d["words"]) < 80 * d["n_words"]),
    Rule("shouting", lambda d: upper_share(d["text"]) > 0.5),
]

#: The same rules over a document of which only text and words are at hand: each counts for itself.
LAZY_RULES = [
    Rule("too_few_words", lambda d: F.size(d["words"]) < 20),
    Rule("repeated_windows", lambda d: 100 * repeated_words(d["words"]) > 30 * F.size(d["words"])),
    Rule("symbols", lambda d: 10 * symbol_count(d["text"]) > F.size(d["words"])),
    Rule(
        "word_length",
        lambda d: (F.size(d["words"]) > 0)
        & ~word_chars(d["words"]).between(3 * F.size(d["words"]), 10 * F.size(d["words"])),
    ),
    Rule("few_letter_words", lambda d: 100 * letter_words(d["words"]) < 80 * F.size(d["words"])),
    CONTENT_RULES[-1],
]


def text_and_words(text: Column) -> Column:
    return F.struct(text.alias("text"), words_of(text).alias("words"))


def counted(text: Column) -> Column:
    """Text, words and the counts of a document, each made once."""
    return bind(
        text_and_words(text),
        lambda d: F.struct(
            d["text"].alias("text"),
            d["words"].alias("words"),
            F.size(d["words"]).cast("long").alias("n_words"),
            word_chars(d["words"]).alias("word_chars"),
            symbol_count(d["text"]).alias("n_symbols"),
            duplicate_lines(lines_of(d["text"])).alias("n_dup_lines"),
            repeated_words(d["words"]).alias("n_repeat_words"),
        ),
    )


def measure(sample: DataFrame, doc: str, rules: list[Rule]) -> list[RuleStats]:
    """Seconds for the rows of the sample, and rejected share, of each rule; it reads the column ``doc``."""
    clock = F.expr("bigint(java_method('java.lang.System', 'nanoTime'))")
    n, verdict = len(rules), F.lit(None).cast("boolean")
    for k in reversed(range(n)):
        verdict = F.when(F.col("rule") == k, F.coalesce(rules[k].rejects(F.col("doc")), F.lit(False))).otherwise(verdict)
    tries = sample.select(F.col(doc).alias("doc"), F.monotonically_increasing_id().alias("row")).withColumn(
        "rule", F.explode(F.array([F.lit(k) for k in range(n)] * TIMES))
    )
    timed = tries.select("row", "rule", F.struct(clock.alias("began"), verdict.alias("rejected"), clock.alias("ended")).alias("t"))
    best = timed.groupBy("row", "rule").agg(F.min(F.col("t.ended") - F.col("t.began")).alias("ns"), F.max("t.rejected").alias("rejected"))
    found = best.groupBy("rule").agg(F.sum("ns").alias("ns"), F.avg(F.col("rejected").cast("int")).alias("share"))
    by = {r["rule"]: r for r in found.collect()}
    return [RuleStats(rule.name, max(by[k]["ns"], 1) / 1e9, by[k]["share"]) if k in by else RuleStats(rule.name, 1.0, 0.0) for k, rule in enumerate(rules)]


def order_rules(rules: list[Rule], stats: list[RuleStats]) -> list[Rule]:
    """Most rejections per second first; those within ``EQUAL`` of the first of a group stand by name."""
    by = {s.name: s for s in stats}
    gain = {r.name: by[r.name].rejected / by[r.name].seconds for r in rules}
    groups: list[list[Rule]] = []
    for rule in sorted(rules, key=lambda r: (-gain[r.name], r.name)):
        if groups and gain[groups[-1][0].name] <= EQUAL * gain[rule.name]:
            groups[-1].append(rule)
        else:
            groups.append([rule])
    return [r for g in groups for r in sorted(g, key=lambda r: r.name)]


def sample_texts(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str | None]:
    """At most ``rows`` texts of up to ``SAMPLE_CHARS`` characters, drawn by hash from ``SAMPLE_FILES`` files at most.

    A table that is not read straight from files is drawn from as a whole.
    """
    files = docs.inputFiles()
    part = docs
    if len(files) > SAMPLE_FILES:
        drawn = sorted(files, key=lambda f: hashlib.sha256(f.encode()).digest())[:SAMPLE_FILES]
        try:
            part = docs.where(F.col("_metadata.file_path").isin([f.replace("file:///", "file:/", 1) for f in drawn] + drawn))
        except AnalysisException:  # columns of its own only
            part = docs
    whole = [F.col(f"`{c}`") for c in docs.columns]
    share = int((1 << 30) * min(1.0, 0.9 * rows / max(1, part.count())))  # seldom more than rows
    short = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)) <= SAMPLE_CHARS
    met = part.where((F.pmod(F.xxhash64(*whole), F.lit(1 << 30)) <= share) & short)
    return [r[0] for r in met.select(F.col(f"`{text}`")).limit(rows).collect()]


def plan_cascade(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules, which read a document of text and words, in the order of their rejections per cost on :func:`sample_texts`."""
    few = sample_texts(docs, text, sample_rows)
    if not few:
        return rules
    spark = docs.sparkSession
    sample = spark.createDataFrame([(t,) for t in few], "text string").repartition(min(8, len(few)))
    sample = sample.select(text_and_words(F.col("text")).alias("doc")).persist()
    try:
        return order_rules(rules, measure(sample, "doc", rules))
    finally:
        sample.unpersist()


def rejected_by(doc: Column, ordered: list[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects the document; null if none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.rejects(doc), F.lit(rule.name)).otherwise(verdict)
    return verdict


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that pass all base and content rules, with their columns.

    Nothing is counted before a rule asks for it, so most junk leaves by a
    cheap rule and the window counts run on the rest alone.
    """
    ordered = plan_cascade(docs, LAZY_RULES, text)
    return docs.where(bind(text_and_words(F.col(f"`{text}`")), lambda d: rejected_by(d, ordered)).isNull())


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every document and the verdict of the cascade.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, rejected_by.  The report needs the base
    counts of all rows, so the base rules come first whatever they cost; the
    content rules run, by measured order, only where the base rules pass.
    """
    base = [rule.name for rule in BASE_RULES]
    by = {r.name: r for r in BASE_RULES + CONTENT_RULES}
    planned = [r.name for r in plan_cascade(docs, LAZY_RULES, text)]
    ordered = [by[n] for n in planned if n in base] + [by[n] for n in planned if n not in base]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = bind(
        counted(F.col(f"`{text}`")),
        lambda d: F.struct(*[d[c].alias(c) for c in counts], rejected_by(d, ordered).alias("rejected_by")),
    )
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), judged.alias("r")).select(
        "doc_id",
        *[F.col("r")[c].alias(c) for c in counts],
        F.coalesce(F.col("r")["rejected_by"].isin(base), F.lit(False)).alias("base_failed"),
        F.col("r")["rejected_by"].isNull().alias("kept"),
        F.col("r")["rejected_by"].alias("rejected_by"),
    )
