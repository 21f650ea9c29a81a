"""License scan: MinHash bands over text windows, then exact containment (native expressions).

Documents and templates become 64-bit hashes of five consecutive words.  A
template of n such shingles is looked for in windows of w shingles, w a power of
two and at least 4 n / 3, every quarter window, so that each run of n lies whole
in a window.  ``BANDS`` bands of one minimum each retrieve the templates of a
window: a window that holds four fifths of a template has a similarity of 0.28
to it at least, and is retrieved with a probability of 1 - 0.72 ** 32, over
0.99997 (an exact copy: over 0.9999999).  Retrieved pairs are verified by the
share of the template's distinct shingles that the window holds.

Documents are cut into segments of ``SEGMENT`` window starts, so that no row
grows with a text.  Only windows around a shingle of some template, which a bit
filter finds, are looked at; the others hold no share of any.  Band keys pass
another bit filter, of the templates' keys, before they are exploded as
(segment, window, key) and joined to the templates; the shingles of a window are
fetched only for pairs that met.  The filters are sized by what they hold, up to
``FILTER_BITS``.  More templates let more through them; results do not change.

Defined results: null texts and texts under five words hold no license; a
template's own text does; equal rows get equal results, one each; empty tables
give no rows; a template under five words is an error; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covlattice.llm.common import bind, cut_lineage, small

SHINGLE = 5
BANDS = 32
CONTAINMENT = 0.8
#: Window starts in a segment of a document; a power of two.
SEGMENT = 2048
#: Shingles of templates that are sent to every task at most (8 MB).
BROADCAST_SHINGLES = 1_000_000
#: Bits for a key of the templates, so that few other hashes of a long text pass, and bits of a filter at most (half a megabyte).
KEY_BITS, FILTER_BITS = 1 << 14, 1 << 22

#: Notices of public licenses, in their published wording.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under "
        "the License."
    ),
    "agpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "bsd-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED."
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."
    ),
    "mit": "Released under the MIT License.",
    "mit-disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software."
    ),
}


def shingles(text: Column) -> Column:
    """Hashes of five consecutive words (letters and digits, lower case), in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def joined(h: Column, k: int, other: Column | None = None) -> Column:
        other = h if other is None else other
        n = F.size(other) - k
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(other, F.lit(1 + k), n), lambda x, y: F.xxhash64(x, y))

    def fives(h: Column) -> Column:
        fours = bind(joined(h, 1), lambda two: joined(two, 2))
        return bind(fours, lambda four: joined(four, 4, h))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return bind(hashed, lambda h: F.when(F.size(h) >= SHINGLE, fives(h)).otherwise(F.array().cast("array<long>")))


def minima(hashes: Column) -> Column:
    """The smallest hash under each of ``BANDS`` orders."""
    orders = F.array(*[F.xxhash64(F.lit(j)) for j in range(BANDS)])
    return F.transform(orders, lambda c: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(c))))


def band_keys(smallest: Column) -> Column:
    """Keys of the bands of these minima."""
    return F.transform(smallest, lambda m, j: F.xxhash64(j, m))


def windows_around(hits: Column, width: int, stride: int, step: int) -> Column:
    """Starts below ``step`` of the windows (every ``stride``) that hold one of the places ``hits``."""

    def around(p: Column) -> Column:
        first = F.greatest(F.lit(0), F.floor((p - width) / stride).cast("int") + 1)
        return F.transform(F.sequence(first, F.floor(p / stride).cast("int")), lambda k: k * stride)

    return F.filter(F.array_distinct(F.flatten(F.transform(hits, around))), lambda at: at < step)


def bit_filter(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that every ``key`` passes and few other hashes do; as many bits as the keys need, ``FILTER_BITS`` at most."""
    bits = 64
    while bits < min(FILTER_BITS, KEY_BITS * keys.count()):
        bits *= 2
    place = F.shiftrightunsigned(F.col(key), 20).bitwiseAND(F.lit(bits - 1))
    word = F.shiftrightunsigned(place, 6).cast("int").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")
    words = [0] * (bits // 64)
    for row in keys.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # bits / 64 rows at most
        words[row["word"]] = row["bits"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")  # a constant of the plan

    def passes(h: Column) -> Column:
        at = F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(bits - 1))
        found = F.get(table, F.shiftrightunsigned(at, 6).cast("int"))
        return F.call_function("shiftrightunsigned", found, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return passes


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, shingles (distinct), width and stride of its windows, and its band keys."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string")
    made = rows.select("template", F.array_distinct(shingles(F.col("text"))).alias("shingles"))
    n = F.size("shingles")
    width = F.when(n == 1, 1).otherwise(F.pow(F.lit(2), F.ceil(F.log2(n * 4 / 3))).cast("int"))
    made = made.select("template", "shingles", width.alias("width"))
    return cut_lineage(
        made.select(
            "template", "shingles", "width", F.greatest(F.lit(1), F.floor(F.col("width") / 4).cast("int")).alias("stride"),
            band_keys(minima(F.col("shingles"))).alias("keys"),
        )
    )


def license_matches(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """All documents as (row_, doc_id), and (row_, template, start_word, containment) of the best windows."""
    spark = docs.sparkSession
    known = template_table(spark, TEMPLATES if templates is None else templates)
    kinds = known.groupBy("width", "stride").agg(F.min(F.size("shingles")).alias("least")).collect()  # a row for each power of two
    if any(k["least"] == 0 for k in kinds):
        raise ValueError(f"a template has fewer than {SHINGLE} words")
    of_template = bit_filter(known.select(F.explode("shingles").alias("h")), "h")
    hashes = bind(shingles(F.col("text_")), lambda hs: F.when(F.exists(hs, of_template), hs))
    light = cut_lineage(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text_"))
        .select("doc_id", F.monotonically_increasing_id().alias("row_"), hashes.alias("hashes"))
    )
    step = max([SEGMENT, *(k["stride"] for k in kinds)])
    reach = step + max((k["width"] for k in kinds), default=0)
    first = F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(step))
    cut = F.transform(first, lambda i: F.struct(i.alias("first"), F.slice("hashes", i + 1, reach).alias("hashes")))
    segments = light.where("size(hashes) > 0").select("row_", F.explode(cut).alias("s")).select("row_", "s.first", "s.hashes")
    filed = cut_lineage(known.select("template", "width", F.explode("keys").alias("key")))
    of_key = bit_filter(filed, "key")

    places = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: of_template(F.get("hashes", i)))
    segments = segments.withColumn("hits", places).where("size(hits) > 0")

    def keyed(width: int, stride: int) -> Column:
        entry = lambda at: lambda k: F.struct(F.lit(width).alias("width"), at.alias("at"), k.alias("key"))
        keys = lambda at: F.filter(band_keys(minima(F.slice("hashes", at + 1, width))), of_key)
        return F.flatten(F.transform(windows_around(F.col("hits"), width, stride, step), lambda at: F.transform(keys(at), entry(at))))

    none = F.array().cast("array<struct<width: int, at: int, key: bigint>>")
    each = [keyed(k["width"], k["stride"]) for k in kinds]
    looked = segments.select("row_", "first", F.explode(F.concat(none, *each)).alias("w")).select("row_", "first", "w.*")
    met = looked.join(small(filed), ["width", "key"]).select("row_", "first", "at", "width", "template").distinct()
    tried = segments.join(small(cut_lineage(met)), ["row_", "first"])
    tried = tried.select("row_", "template", (F.col("first") + F.col("at")).alias("start_word"), F.slice("hashes", F.col("at") + 1, F.col("width")).alias("window"))
    pieces = known.agg(F.sum(F.size("shingles"))).first()[0] or 0
    wanted = known.select("template", "shingles")
    tried = tried.join(F.broadcast(wanted) if pieces <= BROADCAST_SHINGLES else wanted, "template")
    share = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    matches = tried.select("row_", "template", "start_word", share.alias("containment"))
    best = F.max(F.struct("containment", (-F.col("start_word")).alias("at"))).alias("b")
    matches = matches.where(F.col("containment") >= CONTAINMENT).groupBy("row_", "template").agg(best)
    return light.select("row_", "doc_id"), matches.select(
        "row_", "template", (-F.col("b.at")).alias("start_word"), F.col("b.containment").alias("containment")
    )


def license_report(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_licenses and licenses (names in order, joined by commas) of every document."""
    rows, matches = license_matches(docs, templates=templates)
    listed = matches.groupBy("row_").agg(F.sort_array(F.collect_list("template")).alias("names"))
    return rows.join(listed, "row_", "left").select(
        "doc_id",
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"),
    )
