import random

import pytest

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path


def prose(n, seed=0, words=("alpha", "beta", "gamma", "delta", "of", "the", "in", "Zeta", "eta.", "theta,")):
    """``n`` made-up words."""
    r = random.Random(seed)
    return " ".join(r.choice(words) + (str(r.randrange(50)) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def cases():
    """Rows of every awkward kind: nulls, empty and very long texts, copies, repeated rows, odd characters."""
    line = "The quick brown fox jumps over the lazy dog again and again until night falls on us"
    near = prose(400, 3)
    rows = [
        (1, line),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b\f\r "),
        (5, prose(30_000, 1)),
        (6, line),
        (7, line),
        (7, line),
        (None, line + " once more"),
        (None, None),
        (8, "\n".join([line] * 6)),
        (9, near),
        (10, near.replace("Zeta", "zeta") + " end"),
        (11, "É Ñ ß İ \u0301 中文 😀 <|endoftext|> <s> it's we'll \x1c \xa0 ﬁ Σς"),
        (12, "### $$$ %%% && || <> " * 30),
        (13, ("WORD!! " * 7 + "\n") * 9),
        (14, "x"),
        (15, "Licensed under the Apache License, Version 2.0. " + prose(60, 5)),
    ]
    return rows


#: Names that operators use inside, as extra columns of the input.
EXTRA = ["words", "_words", "key", "fp", "root", "part", "size", "row_", "hits", "n", "kept", "shard", "k", "content_", "_id", "text_", "found", "window", "_content_", "_content", "head", "crc", "key_", "size_", "part_", "_key0", "shard_", "number", "rule", "url_", "bad"]


@pytest.fixture(scope="session")
def docs(spark, cases):
    from pyspark.sql import functions as F

    made = spark.createDataFrame(cases, SCHEMA).repartition(3)
    return made.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
