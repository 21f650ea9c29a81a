"""Candidates of runs of the ring against the joins over all of it."""

import pytest
from pyspark.sql import functions as F

from covlattice.operators import coverage, pairs, ringpairs


@pytest.fixture(scope="module", autouse=True)
def small_runs():
    kept = ringpairs.RUN, ringpairs.AFTER
    ringpairs.RUN, ringpairs.AFTER = 32, 24
    yield
    ringpairs.RUN, ringpairs.AFTER = kept


@pytest.fixture(scope="module")
def sigs(spark):
    """Modules: one of many sets, one of a set that half of the samples have, one of a single set, small ones."""
    rows = []
    for n in range(330):
        module = "many" if n < 150 else "hot" if n < 250 else "same" if n < 320 else "few" if n < 329 else "one"
        x = n * 7919 % 1009 if module in ("many", "few", "one") else 5 if module == "same" or n % 2 else n
        rows += [(module, n, t, size, (x // (k + 1) + k) % size) for k, (t, size) in enumerate((("line", 70), ("branch", 9), ("fsm", 4)))]
        rows += [(module, n, "line", 70, (x * 3 + 1) % 70)]
    table = spark.createDataFrame(rows, "module string, sample long, ctype string, n_elements int, element_id int")
    return coverage.signatures(table).localCheckpoint()


def listed(rows):
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("pool", [6, 16])
def test_runs_give_what_joins_give(sigs, pool):
    near = pairs.with_geometry(pairs.informative_pairs(sigs, "3", pool), sigs).select("module", "anchor", "candidate", "similarity")
    strata = pairs.relative_strata(near, "3").localCheckpoint()
    ranked = ringpairs.ranked_candidates(sigs, "3", pool).localCheckpoint()
    assert {r.module for r in ranked.where("not contested").collect()} >= {"many"}
    columns = ["module", "anchor", "candidate", "rank", "pool_size", "stratum", "similarity"]
    assert listed(ringpairs.strata_rows(ranked).select(*columns)) == listed(strata.select(*columns))
    columns = ["module", "anchor", "candidate", "stratum", "place"]
    assert listed(ringpairs.first_of_strata(ranked, pairs.QUOTAS, "3").select(*columns)) == listed(pairs.quota_candidates(strata, seed="3").select(*columns))
    assert listed(ringpairs.select_pairs(ranked, "3")) == listed(pairs.select_pairs(strata, seed="3"))
    assert listed(ringpairs.greedy_pairs(ranked, "3")) == listed(pairs.greedy_pairs(strata, seed="3"))
    counted = strata.groupBy("module", "anchor").agg(F.count("*").alias("pool"), *[F.count_if(F.col("stratum") == s).alias(s) for s in pairs.QUOTAS])
    assert listed(ringpairs.pools(ranked)) == listed(counted)


def test_ranks_round_as_spark_does(spark):
    values = [0.0009765625, 0.5, 1 / 3, 0.1234567885, 0.1234567895, 2.5e-9, 1.0]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 9)).collect()]
    assert [float(x) / 1e9 for x in ringpairs.nano(__import__("numpy").array(values))] == pytest.approx(want, abs=1e-13)


def test_candidates_within_runs(sigs):
    samples = sigs.select("module", "sample")
    for pool in (5, 20):
        assert listed(ringpairs.candidate_pairs(samples, "1", pool)) == listed(pairs.candidate_pairs(samples, "1", pool))
