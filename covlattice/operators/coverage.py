"""Typed coverage sets: signatures, densities, Jaccard and similarity.

A coverage table is long: ``module, sample, ctype, n_elements, element_id``.  A
signature is one row for each sample: an array, in the order of set geometry,
of ``struct<n, words, c>`` - universe, packed set, covered elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covlattice.functions.bits import bit, cardinality, intersection_size
from covlattice.functions.vocab import GEOMETRY_ORDER

#: Words of all types up to which two sets are compared as plain columns; larger ones are compared as arrays.
PLAIN_WORDS = 64
EMPTY = "struct<n: int, words: array<bigint>, c: int>"


def coverage_items(samples: DataFrame) -> DataFrame:
    """Nested ``coverage_vectors`` of ``samples`` (module, sample) as a long table.

    A missing label counts as covered and 0 as uncovered; any other label, or an
    id outside the universe, is an error; a sample without vectors is one too.
    """
    vectors = F.when(F.col("coverage_vectors").isNull(), F.raise_error(F.lit("a sample has no coverage vectors")).cast(
        samples.schema["coverage_vectors"].dataType)).otherwise(F.col("coverage_vectors"))
    typed = samples.select("module", "sample", F.explode(vectors).alias("ctype", "v"))
    item = typed.select("module", "sample", "ctype", F.coalesce("v.element_count", F.lit(0)).alias("n_elements"), F.explode_outer("v.items").alias("i"))
    label = F.coalesce("i.label", F.lit(1))
    bad = F.when(
        F.col("i").isNotNull() & ((F.col("i.id") < 0) | (F.col("i.id") >= F.col("n_elements"))), F.lit("coverage id out of range")
    ).when(F.col("i").isNotNull() & ~label.isin(0, 1), F.lit("coverage label is neither 0 nor 1"))
    element = F.when(bad.isNotNull(), F.raise_error(bad).cast("int")).when(label == 1, F.col("i.id"))
    return item.select("module", "sample", "ctype", "n_elements", element.alias("element_id"))


def signatures(coverage: DataFrame, order: list[str] = GEOMETRY_ORDER) -> DataFrame:
    """(module, sample, sig): packed sets of all coverage types of a sample."""
    words = (
        coverage.groupBy("module", "sample", "ctype", F.floor(F.col("element_id") / 64).cast("int").alias("at"))
        .agg(F.max("n_elements").alias("n"), F.bit_or(bit(F.col("element_id"))).alias("word"))
    )
    per_type = words.groupBy("module", "sample", "ctype").agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "word")))).alias("words")
    )
    size = F.floor((F.col("n") + 63) / 64).cast("int")
    filled = F.when(F.col("n") <= 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.element_at("words", i), F.lit(0)))
    )
    packed = per_type.withColumn("words", filled).withColumn("c", cardinality(F.col("words")))
    one = F.struct(F.col("n").cast("int").alias("n"), "words", "c")
    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("words"), F.lit(0).alias("c"))
    found = packed.groupBy("module", "sample").agg(F.map_from_entries(F.collect_list(F.struct("ctype", one.alias("s")))).alias("by"))
    return found.select(
        "module", "sample", F.array(*[F.coalesce(F.element_at("by", F.lit(c)), none) for c in order]).alias("sig")
    )


def universe(sig: Column) -> Column:
    """Elements of all types together."""
    return F.aggregate(sig, F.lit(0), lambda n, s: n + s["n"])


def nonempty(sigs: DataFrame) -> DataFrame:
    """Samples whose universe is not empty."""
    return sigs.where(universe(F.col("sig")) > 0)


def global_ids(coverage: DataFrame, order: list[str] = GEOMETRY_ORDER) -> DataFrame:
    """Covered elements in one id space: each type's ids after the universes of the types before it."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("ctype"))
    sizes = coverage.groupBy("module", "sample", "ctype").agg(F.max("n_elements").alias("n")).withColumn("place", place)
    before = F.expr("coalesce(sum(n) over (partition by module, sample order by place rows between unbounded preceding and 1 preceding), 0)")
    offsets = sizes.select("module", "sample", "ctype", before.alias("offset"))
    return (
        coverage.where("element_id is not null")
        .join(offsets, ["module", "sample", "ctype"])
        .select("module", "sample", (F.col("offset") + F.col("element_id")).alias("global_id"))
        .distinct()
    )


def density(n: Column, covered: Column) -> Column:
    return F.coalesce(F.try_divide(covered, n), F.lit(0.0))


def densities(sigs: DataFrame, order: list[str] = GEOMETRY_ORDER) -> DataFrame:
    """(module, sample, ctype, n_elements, covered, density)."""
    typed = sigs.select("module", "sample", F.posexplode("sig").alias("at", "s"))
    return typed.select(
        "module",
        "sample",
        F.get(F.array(*[F.lit(c) for c in order]), F.col("at")).alias("ctype"),
        F.col("s.n").alias("n_elements"),
        F.col("s.c").alias("covered"),
        density(F.col("s.n"), F.col("s.c")).alias("density"),
    )


def _geometry(n_a: Column, n_b: Column, c_a: Column, c_b: Column, inter: Column) -> Column:
    n = F.when(n_a == n_b, n_a).otherwise(F.raise_error(F.lit("universes of a pair differ")).cast("int"))
    either = c_a + c_b - inter
    return F.struct(
        density(n, c_a).alias("density_a"),
        density(n, c_b).alias("density_b"),
        (n > 0).alias("size_mask"),
        F.coalesce(F.try_divide(inter, either), F.lit(0.0)).alias("jaccard"),
        (either > 0).alias("iou_mask"),
    )


def pair_geometry(a: Column, b: Column) -> Column:
    """Array of struct<density_a, density_b, size_mask, jaccard, iou_mask> by type; unequal universes are an error."""
    return F.zip_with(a, b, lambda x, y: _geometry(x["n"], y["n"], x["c"], y["c"], intersection_size(x["words"], y["words"])))


def similarity(geometry: Column) -> Column:
    """Mean Jaccard over the types with a non-empty union; 0 if there is none."""
    used = F.filter(geometry, lambda g: g["iou_mask"])
    total = F.aggregate(used, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda s, g: F.struct((s["s"] + g["jaccard"]).alias("s"), (s["n"] + 1).alias("n")))
    return F.coalesce(F.element_at(F.transform(F.array(total), lambda t: F.try_divide(t["s"], t["n"])), 1), F.lit(0.0))


def plain_words(sigs: DataFrame, types: int = len(GEOMETRY_ORDER)) -> list[int] | None:
    """Words that the set of each type needs at most; None if all types together need more than ``PLAIN_WORDS``.

    ``sigs`` is looked at once, so it should be a written table.
    """
    row = sigs.agg(*[F.max(F.size(F.get("sig", F.lit(t))["words"])).alias(f"w{t}") for t in range(types)]).first()
    words = [n or 0 for n in row]
    return words if sum(words) <= PLAIN_WORDS else None


def plain_signature(words: list[int]) -> Column:
    """A signature as a struct of numbers: universe, covered elements and words of each type, for compiled comparisons."""
    fields = []
    for t, size in enumerate(words):
        s = F.get("sig", F.lit(t))
        fields += [s["n"].alias(f"n{t}"), s["c"].alias(f"c{t}")]
        fields += [F.coalesce(F.get(s["words"], F.lit(k)), F.lit(0)).cast("long").alias(f"w{t}_{k}") for k in range(size)]
    return F.struct(*fields)


def plain_geometry(a: Column, b: Column, words: list[int]) -> list[Column]:
    """:func:`pair_geometry` of two plain signatures, a struct for each type."""
    out = []
    for t, size in enumerate(words):
        inter = F.lit(0)
        for k in range(size):
            inter = inter + F.bit_count(a[f"w{t}_{k}"].bitwiseAND(b[f"w{t}_{k}"])).cast("int")
        out.append(_geometry(a[f"n{t}"], b[f"n{t}"], a[f"c{t}"], b[f"c{t}"], inter))
    return out


def plain_similarity(geometry: list[Column]) -> Column:
    """:func:`similarity` of the structs of :func:`plain_geometry`."""
    total, used = F.lit(0.0), F.lit(0)
    for g in geometry:
        total = total + F.when(g["iou_mask"], g["jaccard"]).otherwise(0.0)
        used = used + g["iou_mask"].cast("int")
    return F.coalesce(F.try_divide(total, used), F.lit(0.0))
