import pytest
from pyspark.sql import functions as F

from covlattice.operators import coverage, pairs
from covlattice.plans import queries

VECTORS = "module string, sample string, coverage_vectors map<string, struct<element_count: int, items: array<struct<id: int, label: int>>>>"


def vectors(**sets):
    return {k: (n, [(i, None) if isinstance(i, int) else i for i in ids]) for k, (n, ids) in sets.items()}


def pair(spark, a, b):
    rows = spark.createDataFrame([("m", "a", a), ("m", "b", b)], VECTORS)
    sigs = coverage.signatures(coverage.coverage_items(rows))
    both = pairs.with_geometry(spark.createDataFrame([("m", "a", "b")], "module string, anchor string, candidate string"), sigs)
    return both.first()


def test_similarity_is_the_mean_over_types_with_a_union(spark):
    a = vectors(line=(2, [0]), branch=(3, [0]), toggle=(4, []))
    b = vectors(line=(2, [0]), branch=(3, [1]), toggle=(4, []))
    row = pair(spark, a, b)
    assert row.similarity == 0.5
    by = dict(zip(coverage.GEOMETRY_ORDER, row.geometry))
    assert (by["line"].density_a, by["line"].jaccard, by["line"].iou_mask) == (0.5, 1.0, True)
    assert (by["branch"].density_b, by["branch"].jaccard, by["branch"].iou_mask) == (pytest.approx(1 / 3), 0.0, True)
    assert (by["toggle"].size_mask, by["toggle"].iou_mask, by["fsm"].size_mask) == (True, False, False)


def test_empty_sets(spark):
    assert pair(spark, vectors(line=(2, [])), vectors(line=(2, []))).similarity == 0.0


def test_sets_over_many_words(spark):
    a, b = list(range(0, 1000, 3)), list(range(0, 1000, 2))
    row = pair(spark, vectors(line=(1000, a)), vectors(line=(1000, b)))
    assert row.similarity == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)))


@pytest.mark.parametrize("items, message", [([(2, 1)], "out of range"), ([(-1, 1)], "out of range"), ([(0, 2)], "neither 0 nor 1")])
def test_bad_items_raise(spark, items, message):
    rows = spark.createDataFrame([("m", "a", vectors(line=(2, items)))], VECTORS)
    with pytest.raises(Exception, match=message):
        coverage.coverage_items(rows).collect()


def test_labels_default_to_covered_and_zero_is_ignored(spark):
    rows = spark.createDataFrame([("m", "a", vectors(line=(4, [(0, None), (1, 0), (2, 1), (2, 0)])))], VECTORS)
    found = coverage.densities(coverage.signatures(coverage.coverage_items(rows))).where("ctype = 'line'").first()
    assert (found.covered, found.density) == (2, 0.5)


def test_unequal_universes_and_missing_vectors_raise(spark):
    with pytest.raises(Exception, match="universes"):
        pair(spark, vectors(line=(2, [0])), vectors(line=(3, [0])))
    with pytest.raises(Exception, match="no coverage vectors"):
        coverage.coverage_items(spark.createDataFrame([("m", "a", None)], VECTORS)).collect()


def test_global_ids(spark):
    rows = spark.createDataFrame([("m", "a", vectors(line=(3, [2]), condition=(2, [0]), branch=(4, [1])))], VECTORS)
    assert sorted(r.global_id for r in coverage.global_ids(coverage.coverage_items(rows)).collect()) == [2, 3, 6]


def test_zero_universe_is_left_out(spark):
    rows = spark.createDataFrame([("m", "a", vectors(line=(0, []))), ("m", "b", vectors(line=(1, [])))], VECTORS)
    assert [r.sample for r in coverage.nonempty(coverage.signatures(coverage.coverage_items(rows))).collect()] == ["b"]


@pytest.fixture(scope="module")
def sampled(spark):
    rows = []
    for m in "ab":
        for i in range(20):
            rows.append((m, f"{m}{i:02d}", vectors(line=(32, list(range(i + 1) if i % 2 else range(0, 32, i + 1))))))
    sigs = coverage.signatures(coverage.coverage_items(spark.createDataFrame(rows, VECTORS))).persist()
    return sigs, pairs.relative_strata(pairs.informative(pairs.with_geometry(pairs.candidate_pairs(sigs), sigs)))


def test_pairs_are_unique_within_modules_and_of_all_strata(sampled):
    chosen = pairs.select_pairs(sampled[1]).collect()
    assert len({(r.sample_a, r.sample_b) for r in chosen}) == len(chosen) > 40
    assert all(r.sample_a[0] == r.sample_b[0] == r.module and r.sample_a < r.sample_b for r in chosen)
    assert {r.stratum for r in chosen} == {"low", "mid", "high"}
    per = {}
    for r in chosen:
        per[r.anchor, r.stratum] = per.get((r.anchor, r.stratum), 0) + 1
    assert all(n <= pairs.QUOTAS[s] for (_, s), n in per.items())


def test_strata_of_small_pools(spark):
    for n, want in ((1, "L"), (2, "LH"), (4, "LMMH"), (5, "LLMHH"), (8, "LLMMMMHH")):
        rows = spark.createDataFrame([("m", "a", f"c{k}", k / 10) for k in range(n)], "module string, anchor string, candidate string, similarity double")
        got = sorted((r.rank, r.stratum) for r in pairs.relative_strata(rows).collect())
        assert "".join(s[0].upper() for _, s in got) == want


def test_ring_is_bounded_and_misses_no_one(spark):
    rows = spark.range(400).select(F.lit("m").alias("module"), F.col("id").alias("sample"))
    made = pairs.candidate_pairs(rows, pool=10)
    assert made.count() == 4000 and made.where("anchor = candidate").count() == 0
    assert {r["count"] for r in made.groupBy("candidate").count().collect()} == {10}
    small = pairs.candidate_pairs(rows.where("id < 6"), pool=10)
    assert small.count() == 30


def test_equal_signatures_are_no_candidates_unless_alone(spark):
    rows = [("m", f"s{i}", vectors(line=(4, [0]))) for i in range(4)] + [("m", f"t{i}", vectors(line=(4, [i, 3]))) for i in range(3)]
    sigs = coverage.signatures(coverage.coverage_items(spark.createDataFrame(rows, VECTORS)))
    kept = pairs.informative(pairs.with_geometry(pairs.candidate_pairs(sigs), sigs))
    assert kept.where("anchor LIKE 's%' AND candidate LIKE 's%'").count() == 0
    alone = sigs.where("sample LIKE 's%'")
    assert pairs.informative(pairs.with_geometry(pairs.candidate_pairs(alone), alone)).count() == 12


@pytest.mark.parametrize("pool", [3, 20, 500])
def test_equal_signatures_are_passed_over_before_the_pool_is_counted(spark, pool):
    """300 equal sets and 40 others: by definition, and with more equal neighbours than the pool."""
    kinds = {i: -1 if i < 300 else i // 2 if i < 320 else i for i in range(340)}
    rows = spark.createDataFrame(list(kinds.items()), "sample long, kind long").withColumn("module", F.lit("m"))
    sigs = rows.select("module", "sample", F.array(F.struct(F.lit(400).alias("n"), F.array("kind").alias("words"), F.lit(1).alias("c"))).alias("sig"))
    places = sorted((r.place, r["sample"]) for r in pairs.ring_positions(rows.select("module", "sample"), "0").collect())
    order = [x for _, x in places]
    want = set()
    for at, x in enumerate(order):
        after = [y for y in order[at + 1 :] + order[:at] if kinds[y] != kinds[x]]
        want |= {(x, y) for y in after[:pool]}
    got = [(r.anchor, r.candidate) for r in pairs.informative_pairs(sigs, pool=pool, run=16).collect()]
    assert len(got) == len(want) and set(got) == want
    alone = pairs.informative_pairs(sigs.where("sample < 30"), pool=pool)
    assert alone.count() == 30 * min(pool, 29) and alone.where("anchor = candidate").count() == 0


def test_fingerprint_and_weights_do_not_depend_on_order(spark):
    rows = [("m", f"a{i}", f"b{i % 3}", "low") for i in range(9)]
    one = spark.createDataFrame(rows, "module string, sample_a string, sample_b string, stratum string")
    other = spark.createDataFrame(rows[::-1], one.schema).repartition(3)
    assert pairs.pair_fingerprint(one).first() == pairs.pair_fingerprint(other).first()
    by = {r["sample"]: (r.degree, r.weight) for r in pairs.endpoint_weights(one).collect()}
    assert by["a0"] == (1, 1.5) and by["b0"] == (3, 0.5)


def test_all_pairs_of_a_module_beyond_the_pool(spark):
    rows = spark.range(700).select((F.col("id") % 700 > 599).cast("int").alias("module"), F.col("id").alias("sample"))
    made = pairs.all_pairs(rows, tile=64).select("module", "a.sample", F.col("b.sample").alias("other"))
    assert made.count() == made.distinct().count() == 600 * 599 // 2 + 100 * 99 // 2
    assert made.where("sample >= other OR (sample < 600) <> (other < 600)").count() == 0


def test_the_most_similar_pair_is_found_in_a_large_module(spark, monkeypatch):
    """Two equal sets half a ring apart, which the pool of 256 never compares."""
    ring = pairs.ring_positions(spark.range(700).select(F.lit("m").alias("module"), F.col("id").alias("sample")), "0").collect()
    by_place = {r.place: r["sample"] for r in ring}
    twins = sorted((by_place[0], by_place[350]))
    rows = [("m", i, "line", 2000, e) for i in range(700) for e in ((0, 1) if i in twins else (2 + i, 800 + i))]
    table = spark.createDataFrame(rows, "module string, sample long, ctype string, n_elements int, element_id int")
    monkeypatch.setattr(queries.view, "coverage", lambda s, d: table)
    best = queries.most_similar(spark, "", top=1).first()
    assert ([best.sample_a, best.sample_b], best.similarity) == (twins, 1.0)
