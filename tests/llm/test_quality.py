import re

from pyspark.sql import functions as F

from covlattice.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def verdict(text):
    t = text or ""
    w = WORD.findall(t)
    n, chars, symbols, _, repeated = counts(t)
    if n < 20 or 100 * repeated > 30 * n:
        return True, False
    letters = [c for c in t if c.isalpha()]
    good = (
        10 * symbols <= n
        and 3 * n <= chars <= 10 * n
        and 100 * sum(any(c.isalpha() for c in x) for x in w) >= 80 * n
        and not sum(c.isupper() for c in letters) > 0.5 * max(1, len(letters))
    )
    return False, good


def test_report_is_that_of_brute_force(docs, cases):
    got = quality.quality_report(docs).collect()
    key = lambda r: tuple(str(x) for x in r)
    made = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got), key=key)
    assert made == sorted(((i, *counts(t), *verdict(t)) for i, t in cases), key=key)


def test_filter_keeps_columns_and_the_same_rows(docs, cases):
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in cases if verdict(t)[1])


def test_order_does_not_change_verdicts(spark, docs):
    from covlattice.llm.common import bind

    there = bind(quality.text_and_words(F.col("text")), lambda d: quality.rejected_by(d, quality.LAZY_RULES)).isNull()
    back = bind(quality.text_and_words(F.col("text")), lambda d: quality.rejected_by(d, quality.LAZY_RULES[::-1])).isNull()
    assert docs.where(there != back).count() == 0


def test_cheap_rejections_come_first():
    rules = [quality.Rule(n, None) for n in ("slow", "fast", "never")]
    stats = [quality.RuleStats("slow", 1.0, 0.5), quality.RuleStats("fast", 0.01, 0.1), quality.RuleStats("never", 0.01, 0.0)]
    assert [r.name for r in quality.order_rules(rules, stats)] == ["fast", "slow", "never"]


def test_empty_table(empty):
    assert quality.quality_report(empty).count() == 0
    assert quality.quality_filter(empty).count() == 0


def test_the_order_is_that_of_the_costs(spark, docs):
    """A rule that does twenty times the work for the same rejections is last, in ten of ten runs."""
    sample = spark.range(400).select(quality.text_and_words(F.repeat(F.lit("some words of a text "), 30)).alias("doc")).coalesce(1).persist()
    light = quality.Rule("light", lambda d: F.size(d["words"]) > 0)
    heavy = quality.Rule("a heavy one", lambda d: F.size(F.filter(d["words"], lambda w: F.length(F.regexp_replace(w, "[aeiou]", "")) > 0)) > 0)
    never = quality.Rule("a never", lambda d: F.size(d["words"]) < 0)
    for _ in range(10):
        ordered = quality.order_rules([heavy, never, light], quality.measure(sample, "doc", [heavy, never, light]))
        assert [r.name for r in ordered] == ["light", "a heavy one", "a never"]
    sample.unpersist()


def test_the_sample_is_of_the_whole_table(spark, monkeypatch):
    """Rows of every part of the table are measured, also where one id is very frequent."""
    seen = {}
    monkeypatch.setattr(quality, "measure", lambda sample, doc, rules: seen.setdefault("rows", [r[0] for r in sample.select("doc.text").collect()]) and [quality.RuleStats(r.name, 1.0, 0.5) for r in rules])
    rows = spark.range(10_000).select(F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert len(quality.plan_cascade(rows, quality.LAZY_RULES)) == len(quality.LAZY_RULES)
    assert 300 <= len(seen["rows"]) <= 400 and max(map(int, seen["rows"])) > 9000


def test_a_table_of_many_files_is_sampled_from_some(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_FILES", 3)
    spark.range(2000).select("id", F.col("id").cast("string").alias("text")).repartition(10).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    found = {int(t) for t in quality.sample_texts(table, rows=1000)}
    where = {r.id: r.f for r in table.select("id", F.col("_metadata.file_path").alias("f")).collect()}
    assert len({where[i] for i in found}) == 3 and 450 <= len(found) <= 650
    again = quality.sample_texts(table.select("text", F.length("text").alias("n")), rows=1000)  # a plan above the files
    assert 500 <= len(again) <= 1000


def test_report_and_filter_have_the_same_order_each_time(spark):
    """Costs of rules include the counts they need, so clear differences decide."""
    texts = ["word " * 300, "# " * 300, "a few words", "SHOUT LOUD " * 200, " ".join(str(k) for k in range(300))]
    docs = spark.createDataFrame([(i, texts[i % 5] + str(i)) for i in range(500)], "doc_id long, text string")
    orders = {tuple(r.name for r in quality.plan_cascade(docs, quality.LAZY_RULES)) for _ in range(4)}
    assert {o[0] for o in orders} == {"too_few_words"} and {o.index("symbols") < o.index("repeated_windows") for o in orders} == {True}
