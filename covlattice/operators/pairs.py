"""Comparison pairs within a module: pools, strata, quotas, weights, diagnostics.

Candidates of an anchor are the next ``pool`` samples of its module on a ring
in hash order.  In a module of up to ``pool`` + 1 samples these are all others;
in a larger one each sample is a candidate of ``pool`` anchors, and the rows
grow with the samples, never with their square.

``all_pairs`` has no pool: it pairs a whole module, in tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covlattice.functions.text import sha_prefix, shuffle_key
from covlattice.functions.vocab import GEOMETRY_ORDER
from covlattice.operators.coverage import pair_geometry, plain_geometry, plain_similarity, plain_signature, plain_words, similarity
from covlattice.operators.order import running_total
from covlattice.session import cut_lineage

POOL = 256
TILE = 2048
QUOTAS = {"low": 2, "mid": 1, "high": 1}


def ring_positions(samples: DataFrame, seed: str, slots: int = 256) -> DataFrame:
    """``samples`` (module, sample, ...) with ``place`` on the module's ring and its size ``members``.

    The order is that of a seeded hash.  Its first two digits split a module
    into ``slots`` runs that are numbered apart and put one after the other, so
    that no task has to hold a whole module.
    """
    keyed = samples.withColumn("h", shuffle_key(F.lit(seed), F.col("module"), F.col("sample"))).withColumn("run", F.substring("h", 1, 2))
    runs = keyed.groupBy("module", "run").agg(F.count("*").alias("n"))
    by_module = W.partitionBy("module").orderBy("run")
    before = F.coalesce(F.sum("n").over(by_module.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("module", "run", before.alias("before"), F.sum("n").over(W.partitionBy("module")).alias("members"))
    number = F.row_number().over(W.partitionBy("module", "run").orderBy("h", "sample"))
    return (
        keyed.withColumn("number", number)
        .join(runs, ["module", "run"])
        .withColumn("place", F.col("before") + F.col("number") - 1)
        .drop("h", "run", "before", "number")
    )


def candidate_pairs(samples: DataFrame, seed: str = "0", pool: int = POOL) -> DataFrame:
    """(module, anchor, candidate): every sample with the next ``pool`` of its module's ring."""
    ring = ring_positions(samples.select("module", "sample"), seed)
    steps = F.sequence(F.lit(1).cast("long"), F.least(F.lit(pool).cast("long"), F.col("members") - 1))
    reach = ring.where("members > 1").select("module", F.col("sample").alias("anchor"), F.explode(F.transform(steps, lambda s: (F.col("place") + s) % F.col("members"))).alias("place"))
    there = ring.select("module", "place", F.col("sample").alias("candidate"))
    return reach.join(there, ["module", "place"]).select("module", "anchor", "candidate")


def informative_pairs(sigs: DataFrame, seed: str = "0", pool: int = POOL, run: int = 4096, above: int = 0) -> DataFrame:
    """(module, anchor, candidate): every sample with the next ``pool`` of its module's ring that have another signature.

    Equal signatures are passed over before the pool is counted; a sample has
    them only where its module has no other.  ``u``, the number of samples of
    other signatures before a place, is the same for equal samples side by
    side.  Of the others, number k is at place k plus the equal ones before it;
    so places are looked up by signature and k, at most ``pool`` of them for
    each u, and no task numbers a whole module or signature.  ``above``: anchors
    only whose signature more than that many samples of the module have, but not all.
    """
    kind = F.sha2(F.to_json("sig").cast("binary"), 256)
    ring = ring_positions(sigs.select("module", "sample", kind.alias("kind")), seed).withColumn("run", F.floor(F.col("place") / run))
    runs = ring.groupBy("module", "kind", "run").agg(F.count("*").alias("n"))
    whole = W.partitionBy("module", "kind")
    before = F.coalesce(F.sum("n").over(whole.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("module", "kind", "run", before.alias("before"), F.sum("n").over(whole).alias("equals"))
    rank = F.row_number().over(W.partitionBy("module", "kind", "run").orderBy("place")) - 1
    ring = ring.withColumn("number", rank).join(runs, ["module", "kind", "run"]).withColumn("others", F.col("members") - F.col("equals"))
    ring = ring.withColumn("rank", F.col("before") + F.col("number")).withColumn("u", F.col("place") - F.col("rank"))
    ring = cut_lineage(ring.drop("run", "number", "before"))  # a row for each sample, read four times
    # without equal samples, or with equal ones only, the next places are the candidates
    steps = F.sequence(F.lit(1).cast("long"), F.least(F.lit(pool).cast("long"), F.col("members") - 1))
    asking = ring.where((F.col("equals") > above) & (F.col("others") > 0)) if above else ring
    plain = asking.where("members > 1 AND (equals = 1 OR others = 0)").select(
        "module", F.col("sample").alias("anchor"), F.explode(F.transform(steps, lambda s: (F.col("place") + s) % F.col("members"))).alias("place")
    )
    mixed = asking.where("equals > 1 AND others > 0")
    numbers = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.lit(pool).cast("long"), F.col("others")) - 1), lambda s: F.col("u") + s)).alias("k")
    k = (F.col("k") % F.col("others")).alias("k")
    gaps = mixed.groupBy("module", "kind", "others", "u").agg((F.max("rank") + 1).alias("equal_before"))
    there = gaps.select("module", "kind", "others", "equal_before", numbers)
    there = there.select("module", "kind", k, F.when(F.col("k") < F.col("others"), F.col("k") + F.col("equal_before")).otherwise(F.col("k") - F.col("others")).alias("place"))
    there = there.groupBy("module", "kind", "k").agg(F.max("place").alias("place"))  # that of the last gap before k
    asked = mixed.select("module", "kind", "others", F.col("sample").alias("anchor"), numbers).select("module", "kind", "anchor", k)
    reach = plain.unionByName(asked.join(there, ["module", "kind", "k"]).select("module", "anchor", "place"))
    return reach.join(ring.select("module", "place", F.col("sample").alias("candidate")), ["module", "place"]).select("module", "anchor", "candidate")


def all_pairs(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(module, a, b): the rows of every unordered pair of a module's samples, the smaller sample in ``a``.

    Samples fall into blocks of about ``tile`` by hash.  Two blocks, or one with
    itself, make a tile, and tiles are dealt over the tasks: a module of n
    samples is sent n / ``tile`` times and its pairs are made by many tasks.
    """
    keyed = rows.select("module", F.struct(*rows.columns).alias("r"))
    counts = keyed.groupBy("module").agg(F.ceil(F.count("*") / tile).alias("blocks"))
    blocked = keyed.join(counts, "module").withColumn("block", F.pmod(F.xxhash64("r.sample"), F.col("blocks")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # asked for by number, or few bytes would become few tasks
    at = ["module", "i", "j"]
    left = blocked.select("module", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("r").alias("x"))
    right = blocked.select("module", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), F.col("r").alias("y"))
    met = left.repartition(parts, *at).join(right.repartition(parts, *at), at).where("i < j OR x.sample < y.sample")
    less = F.col("x.sample") < F.col("y.sample")
    return met.select("module", F.when(less, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(less, F.col("y")).otherwise(F.col("x")).alias("b"))


def end_counts(rows: DataFrame, used: Column) -> DataFrame:
    """``rows`` (module, sample, ...), one for each sample, with ``ends``: of the unordered pairs of its module whose smaller sample is ``used``, those it is in.

    ``as_a`` and ``as_b``: all its pairs in which it is the smaller or the larger sample.
    """
    marked = rows.where("module IS NOT NULL").withColumn("used_", used.cast("long")).withColumn("one_", F.lit(1).cast("long"))
    placed = running_total(marked, ["sample"], "used_", "before_", ["module"])  # smaller ones that are used
    placed = running_total(placed, ["sample"], "one_", "at_", ["module"])
    sizes = marked.groupBy("module").agg(F.count(F.lit(1)).alias("all_"))
    placed = placed.join(sizes, "module").withColumn("as_a", F.col("all_") - F.col("at_") - 1)
    return placed.withColumn("ends", F.col("before_") + F.col("used_") * F.col("as_a")).withColumnRenamed("at_", "as_b").drop("used_", "one_", "before_", "all_")


def _compared(met: DataFrame, a: str, b: str, words: list[int] | None, same: bool = False) -> DataFrame:
    """``met`` with geometry and similarity of the signatures in the columns a and b, in place of them."""
    x, y = F.col(a), F.col(b)
    if words is None:
        made = met.withColumn("geometry", pair_geometry(x, y))
        alike = similarity(F.col("geometry"))
    else:
        each = plain_geometry(x, y, words)
        made = met.withColumn("geometry", F.array(*each))
        alike = plain_similarity(each)
    if same:
        made = made.withColumn("same", x == y)
    return made.withColumn("similarity", alike).drop(a, b)


def all_geometry(sigs: DataFrame, tile: int = TILE) -> DataFrame:
    """(module, sample_a, sample_b, geometry, similarity) of every unordered pair of a module; ``sigs`` is read twice."""
    words = plain_words(sigs)
    sig = F.col("sig") if words is None else plain_signature(words)
    met = all_pairs(sigs.select("module", "sample", sig.alias("sig")), tile)
    met = met.select("module", F.col("a.sample").alias("sample_a"), F.col("b.sample").alias("sample_b"), F.col("a.sig").alias("x"), F.col("b.sig").alias("y"))
    return _compared(met, "x", "y", words)


def with_geometry(pairs: DataFrame, sigs: DataFrame, a: str = "anchor", b: str = "candidate") -> DataFrame:
    """``pairs`` with the ``geometry`` of their signatures, their ``similarity``, and if they are the ``same``.

    The end ``a`` is joined last, so that what follows by (module, a) needs no
    other exchange.
    """
    words = plain_words(sigs)
    sig = F.col("sig") if words is None else plain_signature(words)
    right = sigs.select("module", F.col("sample").alias(b), sig.alias("sig_b"))
    left = sigs.select("module", F.col("sample").alias(a), sig.alias("sig_a"))
    both = pairs.join(right, ["module", b]).join(left, ["module", a])
    return _compared(both, "sig_a", "sig_b", words, same=True)


def unordered(pairs: DataFrame, a: str = "anchor", b: str = "candidate") -> DataFrame:
    """One row for each pair of samples, the smaller first."""
    return pairs.select("module", F.least(a, b).alias("sample_a"), F.greatest(a, b).alias("sample_b")).distinct()


def informative(pairs: DataFrame) -> DataFrame:
    """Drop candidates of the anchor's own signature, unless it has no others."""
    other = F.max(~F.col("same")).over(W.partitionBy("module", "anchor"))
    return pairs.withColumn("others", other).where("not same or not others").drop("others")


def relative_strata(pairs: DataFrame, seed: str = "0") -> DataFrame:
    """``rank`` of the candidates of an anchor by similarity, ``pool_size`` and ``stratum``.

    The lowest quarter, rounded up, is low; ranks from three quarters, rounded
    down, but not below the end of low, are high; the rest is mid.  Ties are in
    hash order.
    """
    anchor = W.partitionBy("module", "anchor")
    tie = shuffle_key(F.lit(seed), F.col("anchor"), F.col("candidate"))
    ranked = pairs.withColumn("rank", F.row_number().over(anchor.orderBy(F.round("similarity", 9), tie)))
    n = F.count("*").over(anchor)
    low_end = F.greatest(F.lit(1), F.ceil(n / 4))
    high_start = F.greatest(low_end, F.floor(n * 3 / 4))
    stratum = F.when(F.col("rank") <= low_end, "low").when(F.col("rank") > high_start, "high").otherwise("mid")
    return ranked.withColumn("pool_size", n).withColumn("stratum", stratum)


def quota_candidates(strata: DataFrame, quotas: dict[str, int] | None = None, seed: str = "0") -> DataFrame:
    """Of each stratum of an anchor the first ``quotas[stratum]`` in hash order."""
    quotas = QUOTAS if quotas is None else quotas
    order = shuffle_key(F.lit(seed), F.col("stratum"), F.col("anchor"), F.col("candidate"))
    place = F.row_number().over(W.partitionBy("module", "anchor", "stratum").orderBy(order))
    limit = F.lit(0)
    for name, n in quotas.items():
        limit = F.when(F.col("stratum") == name, F.lit(n)).otherwise(limit)
    return strata.withColumn("place", place).where(F.col("place") <= limit)


def select_pairs(strata: DataFrame, quotas: dict[str, int] | None = None, seed: str = "0") -> DataFrame:
    """Pairs that fill the quotas without choosing any pair twice.

    Every anchor proposes all its candidates in hash order by stratum.  A pair
    that both ends propose belongs to the end with the better place (then the
    smaller sample); an anchor fills its quota from the pairs that belong to it.
    This replaces a greedy pass over the anchors: it needs no order among them,
    keeps the same guarantees (unique pairs, quotas never exceeded, repair
    within the stratum) and may underfill as that does.
    """
    quotas = QUOTAS if quotas is None else quotas
    order = shuffle_key(F.lit(seed), F.col("stratum"), F.col("anchor"), F.col("candidate"))
    place = F.row_number().over(W.partitionBy("module", "anchor", "stratum").orderBy(order))
    proposed = strata.withColumn("place", place).withColumn("sample_a", F.least("anchor", "candidate")).withColumn("sample_b", F.greatest("anchor", "candidate"))
    owner = F.row_number().over(W.partitionBy("module", "sample_a", "sample_b").orderBy("place", "anchor"))
    own = proposed.withColumn("owner", owner).where("owner = 1")
    filled = F.row_number().over(W.partitionBy("module", "anchor", "stratum").orderBy("place"))
    limit = F.lit(0)
    for name, n in quotas.items():
        limit = F.when(F.col("stratum") == name, F.lit(n)).otherwise(limit)
    return own.withColumn("filled", filled).where(F.col("filled") <= limit).select("module", "sample_a", "sample_b", "anchor", "stratum", "similarity")


def greedy_pairs(strata: DataFrame, quotas: dict[str, int] | None = None, seed: str = "0") -> DataFrame:
    """Pairs that fill the quotas as one pass over the anchors does, and the same pairs as it.

    The pass takes a module's anchors in hash order; an anchor takes, in each
    stratum, the first of its candidates in hash order whose pair no earlier
    anchor has taken.  Here all anchors choose at once, again and again: in each
    round an anchor is denied the pairs that earlier anchors chose in the round
    before.  The first anchors are right from the first round on, those that
    depend on them from the next, and choices that a round leaves unchanged are
    those of the pass.  So the set is maximal: an anchor under its quota has no
    pair of that stratum left.  Only what is denied goes from round to round, at
    most the quotas' sum for each anchor.
    """
    quotas = QUOTAS if quotas is None else quotas
    within = shuffle_key(F.lit(seed), F.col("stratum"), F.col("anchor"), F.col("candidate"))
    one = F.struct(within.alias("h"), "candidate", "similarity")
    listed = [F.array_sort(F.collect_list(F.when(F.col("stratum") == s, one))).alias(f"in_{s}") for s in quotas]
    lists = cut_lineage(strata.groupBy("module", "anchor").agg(*listed))
    denied = lists.select("module", "anchor", F.array().cast(f"array<{strata.schema['anchor'].dataType.simpleString()}>").alias("denied")).limit(0)
    key = ["module", "anchor"]
    earlier = shuffle_key(F.lit(seed), F.col("module"), F.col("anchor")), shuffle_key(F.lit(seed), F.col("module"), F.col("c.candidate"))
    while True:
        met = lists.join(denied, key, "left")
        free = lambda s: F.filter(f"in_{s}", lambda x: ~F.coalesce(F.array_contains("denied", x["candidate"]), F.lit(False)))  # noqa: B023, E731
        taken = F.flatten(F.array(*[F.transform(F.slice(free(s), 1, q), lambda x: F.struct(F.lit(s).alias("stratum"), x["candidate"].alias("candidate"), x["similarity"].alias("similarity"))) for s, q in quotas.items()]))  # noqa: B023
        chosen = cut_lineage(met.select(*key, F.explode(taken).alias("c")))
        mine = earlier[0] < earlier[1], (earlier[0] == earlier[1]) & (F.col("anchor") < F.col("c.candidate"))
        told = chosen.where(mine[0] | mine[1]).groupBy("module", F.col("c.candidate").alias("anchor")).agg(F.array_sort(F.collect_set("anchor")).alias("denied"))
        told = cut_lineage(told)
        if denied.join(told, [*key, "denied"], "full").count() == denied.count() == told.count():
            break
        denied = told
    return chosen.select(
        "module", F.least("anchor", "c.candidate").alias("sample_a"), F.greatest("anchor", "c.candidate").alias("sample_b"), "anchor",
        F.col("c.stratum").alias("stratum"), F.col("c.similarity").alias("similarity"),
    )


def degrees(pairs: DataFrame) -> DataFrame:
    """(module, sample, degree) of the ends of unordered pairs."""
    ends = pairs.select("module", F.explode(F.array("sample_a", "sample_b")).alias("sample"))
    return ends.groupBy("module", "sample").agg(F.count("*").alias("degree"))


def endpoint_weights(pairs: DataFrame) -> DataFrame:
    """(module, sample, degree, weight): the mean degree over the sample's own."""
    by_sample = degrees(pairs)
    mean = by_sample.agg(F.avg("degree").alias("mean_degree"))  # one row
    return by_sample.join(F.broadcast(mean)).select("module", "sample", "degree", (F.col("mean_degree") / F.col("degree")).alias("weight"))


def pair_records(chosen: DataFrame, sigs: DataFrame, order: list[str] = GEOMETRY_ORDER) -> DataFrame:
    """A row for each chosen pair and coverage type: its five targets, and degree and weight of both ends.

    (module, sample_a, sample_b, stratum, ctype, density_a, density_b,
    size_mask, jaccard, iou_mask, degree_a, degree_b, weight_a, weight_b).
    ``chosen`` and ``sigs`` are read more than once.
    """
    met = with_geometry(chosen.select("module", "sample_a", "sample_b", "stratum"), sigs, "sample_a", "sample_b")
    weights = endpoint_weights(chosen)
    for e in "ab":
        ends = weights.select("module", F.col("sample").alias(f"sample_{e}"), F.col("degree").alias(f"degree_{e}"), F.col("weight").alias(f"weight_{e}"))
        met = met.join(ends, ["module", f"sample_{e}"])
    kinds = F.array(*[F.lit(c) for c in order])
    long = met.select("module", "sample_a", "sample_b", "stratum", F.posexplode("geometry").alias("k", "g"), "degree_a", "degree_b", "weight_a", "weight_b")
    return long.select("module", "sample_a", "sample_b", "stratum", F.get(kinds, F.col("k")).alias("ctype"), "g.*", "degree_a", "degree_b", "weight_a", "weight_b")


def pair_fingerprint(pairs: DataFrame) -> DataFrame:
    """A hash of a set of pairs that does not depend on their order.

    Pairs are hashed in 256 groups by the first digits of their own hash, then
    the groups' hashes, so that no task gathers all pairs.
    """
    line = F.sha2(F.concat_ws("|", F.col("sample_a").cast("string"), F.col("sample_b").cast("string"), "stratum").cast("binary"), 256)
    groups = pairs.select(line.alias("h")).groupBy(F.substring("h", 1, 2).alias("g")).agg(
        F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 3, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("s")
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "n", "s"))), lambda x: F.concat_ws(":", x["g"], x["n"].cast("string"), x["s"])), "\n")
    return groups.agg(F.sum("n").alias("n_pairs"), sha_prefix(listed, 16).alias("fingerprint"))


def equal_candidates(sigs: DataFrame) -> DataFrame:
    """One row (equal_candidates): ordered pairs of a module's samples that have the same signature."""
    kind = F.sha2(F.to_json("sig").cast("binary"), 256)
    n = sigs.groupBy("module", kind.alias("kind")).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("equal_candidates"))


def pair_diagnostics(strata: DataFrame, chosen: DataFrame, sigs: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """One row: pools, degrees, similarity, the set's fingerprint, and by stratum the pairs asked for, at hand and found.

    ``requested_x`` is the quota of every anchor, ``available_x`` what its
    stratum can give of it.  ``conflicts`` are pairs that both ends have within
    their quota; ``degree_zero`` anchors are in no pair; ``equal_candidates``
    were passed over for their signature.
    """
    quotas = QUOTAS if quotas is None else quotas
    pools = strata.groupBy("module", "anchor").agg(
        F.count("*").alias("pool"), *[F.count_if(F.col("stratum") == s).alias(s) for s in quotas]
    )
    return diagnostics(pools, quota_candidates(strata, quotas), chosen, sigs, quotas)


def diagnostics(pools: DataFrame, proposed: DataFrame, chosen: DataFrame, sigs: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """:func:`pair_diagnostics` of the sizes of the pools (module, anchor, pool, and each stratum) and the proposed pairs."""
    asked = [(F.count("*") * q).alias(f"requested_{s}") for s, q in quotas.items()]
    there = [F.sum(F.least(F.col(s), F.lit(q))).alias(f"available_{s}") for s, q in quotas.items()]
    a = pools.agg(
        F.count("*").alias("n_anchors"), F.min("pool").alias("pool_min"), F.avg("pool").alias("pool_mean"), F.max("pool").alias("pool_max"), *asked, *there
    )
    b = degrees(chosen).agg(
        F.count("*").alias("n_endpoints"), F.min("degree").alias("degree_min"), F.avg("degree").alias("degree_mean"), F.max("degree").alias("degree_max")
    )
    c = chosen.agg(
        F.count("*").alias("n_pairs"),
        F.round(F.min("similarity"), 6).alias("similarity_min"),
        F.round(F.avg("similarity"), 6).alias("similarity_mean"),
        F.round(F.max("similarity"), 6).alias("similarity_max"),
        *[F.count_if(F.col("stratum") == s).alias(f"fulfilled_{s}") for s in quotas],
    )
    met = unordered(proposed).agg(F.count("*").alias("met_"))
    asked_for = proposed.agg(F.count("*").alias("proposed_"))
    made = a
    for one in (b, c, met, asked_for, equal_candidates(sigs), pair_fingerprint(chosen).select("fingerprint")):  # one row each
        made = made.join(F.broadcast(one))
    return (
        made.withColumn("conflicts", F.col("proposed_") - F.col("met_"))
        .withColumn("degree_zero", F.col("n_anchors") - F.col("n_endpoints"))
        .drop("proposed_", "met_")
    )
