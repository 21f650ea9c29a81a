"""Ranked candidates of every sample: ring, signatures and order of a run of places are looked at within a task.

Candidates of an anchor follow it on its module's ring, so a run of places and
the places after it hold all that its anchors need.  A row is sent once or twice,
never once for each pair, and a row comes back for each anchor, not for each
candidate.  Signatures with so many copies in a module that the places after a
run may not be enough take :func:`covlattice.operators.pairs.informative_pairs`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covlattice.operators import pairs
from covlattice.session import cut_lineage

#: Places of a run, and places after it that go with it.
RUN, AFTER = 2048, 1024
#: Anchors that are compared at once.
STEP = 256


def nano(x: np.ndarray) -> np.ndarray:
    """``x`` in billionths, as ``round(x, 9)`` gives them: half up, by the decimal digits."""
    y = x * 1e9
    made = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-5):
        made[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP).scaleb(9))
    return made


def similarities(v: np.ndarray, types: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Mean Jaccard of the rows i and j of ``v`` (universes, counts, words) over the types with a non-empty union."""
    ends = 2 * types + np.cumsum([0, *(-(-v[0, :types] // 64))])
    total, used = np.zeros(len(i)), np.zeros(len(i))
    for t in range(types):
        inter = np.zeros(len(i), np.int64)
        for w in range(ends[t], ends[t + 1]):
            word = np.ascontiguousarray(v[:, w]).view(np.uint64)
            inter += np.bitwise_count(word[i] & word[j])
        c = np.ascontiguousarray(v[:, types + t])
        either = c[i] + c[j] - inter
        some = either > 0
        total += np.divide(inter, either, out=np.zeros(len(i)), where=some)
        used += some
    return np.divide(total, used, out=np.zeros(len(i)), where=used > 0)


def _ranked(v: np.ndarray, types: int, sample: pa.Array, alone: np.ndarray, own: int, seed: str, pool: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first anchor, candidates of each, their places, similarities) in the order of ranks, for the first ``own`` rows of a run."""
    if not (v[:, :types] == v[0, :types]).all():
        raise ValueError("universes of a pair differ")
    kind = np.unique(v, axis=0, return_inverse=True)[1].ravel()
    names = None
    for low in range(0, own, STEP):
        high = min(own, low + STEP)
        reach = len(v) - own  # the other places of the ring, or as many as a run has after it
        at = np.arange(low, high)[:, None] + np.arange(1, reach + 1)[None, :]
        other = (kind[at] != kind[low:high, None]) | alone[low:high, None]
        other &= np.cumsum(other, axis=1) <= pool
        i, s = np.nonzero(other)
        j = i + low + s + 1
        alike = similarities(v, types, i + low, j)
        order = np.lexsort((j, nano(alike), i))
        i, j, alike = i[order], j[order], alike[order]
        key = nano(alike)
        tied = (i[1:] == i[:-1]) & (key[1:] == key[:-1])
        if tied.any():
            names = sample.cast(pa.string()).to_pylist() if names is None else names
            starts = np.flatnonzero(np.diff(np.concatenate([[0], tied.astype(np.int8), [0]])) == 1)
            stops = np.flatnonzero(np.diff(np.concatenate([[0], tied.astype(np.int8), [0]])) == -1) + 1
            for a, b in zip(starts, stops):
                head = f"{seed}|{names[low + i[a]]}|"
                j[a:b] = sorted(j[a:b], key=lambda c: hashlib.md5((head + names[c]).encode()).digest())  # noqa: B023
        yield low, np.bincount(i, minlength=high - low), j, alike


def _runs(ring: DataFrame, values: Column) -> DataFrame:
    """(module, run, q, own, sample, alone, v): the places of each run and those after it, numbered within."""
    p, m = F.col("place"), F.col("members")
    runs = F.ceil(m / RUN)
    h = F.least(F.lit(AFTER), m - 1)
    empty = F.array().cast("array<bigint>")
    span = lambda low, high: F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(empty)
    # a run that begins at (r - 1) * RUN ends at r * RUN, the last one at the ring's first place
    near = F.transform(span(F.greatest(F.lit(1), F.floor((p - h) / RUN) + 1), F.floor(p / RUN)), lambda r: F.struct((r - 1).alias("run"), (p - (r - 1) * RUN).alias("q"), F.lit(False).alias("own")))
    round_ = F.transform(span(F.greatest(F.lit(1), F.floor((p + m - h) / RUN) + 1), runs - 1), lambda r: F.struct((r - 1).alias("run"), (p + m - (r - 1) * RUN).alias("q"), F.lit(False).alias("own")))
    last = F.filter(F.array(F.struct((runs - 1).cast("long").alias("run"), (p + m - (runs - 1) * RUN).cast("long").alias("q"), F.lit(False).alias("own"))), lambda x: p < h)
    mine = F.array(F.struct(F.floor(p / RUN).alias("run"), (p % RUN).alias("q"), F.lit(True).alias("own")))
    sent = ring.select("module", "sample", "alone", "hot", values.alias("v"), F.explode(F.concat(mine, near, round_, last)).alias("t"))
    return sent.select("module", F.col("t.run").alias("run"), F.col("t.q").alias("q"), F.col("t.own").alias("own"), "sample", "alone", "hot", "v")


def _each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of a run at a time; each begins with q = 0."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = np.flatnonzero(batch.column("q").to_numpy() == 0).tolist()
        for low, high in zip([0, *first], [*first, batch.num_rows]):
            if low in first and held:
                yield held
                held = []
            if high > low:
                held.append(batch.slice(low, high - low))
    if held:
        yield held


def _sent(ring: DataFrame, values: Column) -> DataFrame:
    parts = int(ring.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _runs(ring, values).repartition(parts, "module", "run").sortWithinPartitions("module", "run", "q")


def candidate_pairs(samples: DataFrame, seed: str = "0", pool: int = pairs.POOL) -> DataFrame:
    """:func:`covlattice.operators.pairs.candidate_pairs`: (module, anchor, candidate), made within runs of the ring."""
    if not 0 < pool <= AFTER:
        raise ValueError("a pool lies within the places after a run")
    ring = pairs.ring_positions(samples.select("module", "sample"), seed).withColumns({"alone": F.lit(True), "hot": F.lit(False)})
    kinds = {f.name: f.dataType.simpleString() for f in samples.select("module", "sample").schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _each_run(batches):
            rows = pa.Table.from_batches(held).combine_chunks()
            module, sample = rows.column("module")[0], rows.column("sample").combine_chunks()
            own = int(rows.column("own").to_numpy(zero_copy_only=False).sum())
            reach = min(pool, len(rows) - own)
            for low in range(0, own if reach else 0, STEP):
                i = np.repeat(np.arange(low, min(own, low + STEP)), reach)
                j = i + np.tile(np.arange(1, reach + 1), len(i) // reach)
                yield pa.RecordBatch.from_arrays([pa.repeat(module, len(i)), sample.take(pa.array(i)), sample.take(pa.array(j))], names=["module", "anchor", "candidate"])

    sent = _sent(ring, F.array(F.lit(0).cast("bigint")))
    return sent.mapInArrow(run, f"module {kinds['module']}, anchor {kinds['sample']}, candidate {kinds['sample']}")


def ranked_candidates(sigs: DataFrame, seed: str = "0", pool: int = pairs.POOL) -> DataFrame:
    """(module, anchor, contested, ranked): the candidates of every sample by similarity, ties in hash order.

    ``ranked`` is an array of struct<candidate, similarity>; candidates are those
    of :func:`covlattice.operators.pairs.informative_pairs`, the ranks those of
    :func:`covlattice.operators.pairs.relative_strata`.  Samples without any
    candidate have no row.  ``contested``: two samples of the module may be
    candidates of each other.  ``sigs`` is read more than once.
    """
    if not 0 < pool < AFTER:
        raise ValueError("a pool lies within the places after a run")
    digest = F.sha2(F.to_json("sig").cast("binary"), 256)
    kinds = cut_lineage(sigs.groupBy("module", digest.alias("kind")).agg(F.count(F.lit(1)).alias("equals")))
    modules = kinds.groupBy("module").agg(F.sum("equals").alias("all_"), F.max("equals").alias("most_"))
    modules = cut_lineage(modules.withColumn("contested", F.col("all_") <= 2 * (pool + F.col("most_"))))
    limit = AFTER - pool + 1  # copies that AFTER places can hold beside the pool
    few = kinds.where((F.col("equals") > limit)).join(modules.select("module", "all_"), "module").where("equals < all_").select("module", "kind")
    few = cut_lineage(few)  # of each module at most its samples / limit
    hot = not few.isEmpty()
    rows = sigs.select("module", "sample", "sig")
    ring = pairs.ring_positions(rows, seed).join(modules.select("module", (F.col("most_") == F.col("all_")).alias("alone")), "module")
    if hot:
        ring = ring.withColumn("kind", digest).join(few.withColumn("hot", F.lit(True)), ["module", "kind"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))).drop("kind")
    else:
        ring = ring.withColumn("hot", F.lit(False))
    sig = F.col("sig")
    values = F.concat(F.transform(sig, lambda s: s["n"].cast("long")), F.transform(sig, lambda s: s["c"].cast("long")), F.flatten(F.transform(sig, lambda s: s["words"])))
    sent = _sent(ring, values)
    kind = sigs.schema["sample"].dataType.simpleString()
    schema = f"module {sigs.schema['module'].dataType.simpleString()}, anchor {kind}, ranked array<struct<candidate: {kind}, similarity: double>>"
    types = len(pairs.GEOMETRY_ORDER)

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        module, sample = rows.column("module")[0], rows.column("sample").combine_chunks()
        v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        own = rows.column("own").to_numpy(zero_copy_only=False)
        skipped, alone = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("hot", "alone"))
        for low, counts, j, alike in _ranked(v, types, sample, alone, int(own.sum()), seed, pool):
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            found = pa.StructArray.from_arrays([sample.take(pa.array(j)), pa.array(alike)], names=["candidate", "similarity"])
            anchors = sample.slice(low, len(counts))
            made = pa.RecordBatch.from_arrays([pa.repeat(module, len(counts)), anchors, pa.ListArray.from_arrays(pa.array(ends), found)], names=["module", "anchor", "ranked"])
            yield made.filter(pa.array((counts > 0) & ~skipped[low : low + len(counts)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _each_run(batches):
            yield from one(held)

    found = sent.mapInArrow(run, schema)
    if hot:
        near = pairs.with_geometry(pairs.informative_pairs(sigs, seed, pool, above=limit), sigs)
        rest = pairs.relative_strata(near.select("module", "anchor", "candidate", "similarity"), seed)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate", "similarity"))), lambda x: F.struct(x["candidate"].alias("candidate"), x["similarity"].alias("similarity")))
        found = found.unionByName(rest.groupBy("module", "anchor").agg(listed.alias("ranked")))
    return found.join(F.broadcast(modules.select("module", "contested")), "module") if _few(modules) else found.join(modules.select("module", "contested"), "module")


def _few(modules: DataFrame, most: int = 1 << 20) -> bool:
    return modules.count() <= most


def _stratum(n: Column) -> dict[str, tuple[Column, Column]]:
    """First place and number of each stratum in a list of ``n`` ranked candidates; see ``relative_strata``."""
    low = F.greatest(F.lit(1), F.ceil(n / 4)).cast("int")
    high = F.greatest(low, F.floor(n * 3 / 4).cast("int"))
    return {"low": (F.lit(1), low), "mid": (low + 1, high - low), "high": (high + 1, n - high)}


def strata_rows(ranked: DataFrame) -> DataFrame:
    """(module, anchor, candidate, rank, pool_size, stratum, similarity): a row for each candidate."""
    n = F.size("ranked")
    rows = ranked.select("module", "anchor", n.cast("long").alias("pool_size"), F.posexplode("ranked").alias("at", "t"))
    n, rank = F.col("pool_size"), F.col("at") + 1
    at = _stratum(n)
    stratum = F.when(rank < at["mid"][0], "low").when(rank >= at["high"][0], "high").otherwise("mid")
    return rows.select("module", "anchor", F.col("t.candidate").alias("candidate"), rank.alias("rank"), "pool_size", stratum.alias("stratum"), F.col("t.similarity").alias("similarity"))


def first_of_strata(ranked: DataFrame, quotas: dict[str, int], seed: str = "0") -> DataFrame:
    """(module, anchor, candidate, similarity, stratum, place): of each stratum the first of its quota in hash order, from the lists alone."""
    at = _stratum(F.size("ranked"))

    def of(name: str) -> Column:
        key = lambda x: F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), F.col("anchor").cast("string"), x["candidate"].cast("string")).cast("binary"))
        listed = F.transform(F.slice("ranked", *at[name]), lambda x: F.struct(key(x).alias("h"), x["candidate"].alias("candidate"), x["similarity"].alias("similarity")))
        return F.transform(F.slice(F.array_sort(listed), 1, quotas[name]), lambda x, i: F.struct(x["candidate"].alias("candidate"), x["similarity"].alias("similarity"), F.lit(name).alias("stratum"), (i + 1).alias("place")))

    made = ranked.select("module", "anchor", F.explode(F.concat(*[of(s) for s in quotas])).alias("t"))
    return made.select("module", "anchor", "t.*")


def _both_ways(first: DataFrame, rest: DataFrame) -> DataFrame:
    first = first.select(
        "module", F.least("anchor", "candidate").alias("sample_a"), F.greatest("anchor", "candidate").alias("sample_b"), "anchor", "stratum", "similarity"
    )
    return first.unionByName(rest)


def select_pairs(ranked: DataFrame, seed: str = "0", quotas: dict[str, int] | None = None) -> DataFrame:
    """:func:`covlattice.operators.pairs.select_pairs`; where no pair can have two anchors, each anchor's first candidates are its pairs."""
    quotas = pairs.QUOTAS if quotas is None else quotas
    first = first_of_strata(ranked.where("not contested"), quotas, seed)
    return _both_ways(first, pairs.select_pairs(strata_rows(ranked.where("contested")), quotas, seed))


def greedy_pairs(ranked: DataFrame, seed: str = "0", quotas: dict[str, int] | None = None) -> DataFrame:
    """:func:`covlattice.operators.pairs.greedy_pairs`; where no pair can have two anchors, no anchor denies another one anything."""
    quotas = pairs.QUOTAS if quotas is None else quotas
    first = first_of_strata(ranked.where("not contested"), quotas, seed)
    return _both_ways(first, pairs.greedy_pairs(strata_rows(ranked.where("contested")), quotas, seed))


def pools(ranked: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """(module, anchor, pool, low, mid, high): the candidates of every anchor by stratum."""
    quotas = pairs.QUOTAS if quotas is None else quotas
    at = _stratum(F.size("ranked"))
    return ranked.select("module", "anchor", F.size("ranked").cast("long").alias("pool"), *[at[s][1].cast("long").alias(s) for s in quotas])
