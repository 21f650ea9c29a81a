"""The pipeline against brute force, on documents of every kind."""

import hashlib

import corpus_pipeline

from . import test_decontaminate as bench_test
from . import test_quality as quality_test
from . import test_simhash as simhash_test
from .conftest import SCHEMA, prose


def test_stages_and_run(spark, cases, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    passage = "a passage of the benchmark that is long enough to be found in documents that hold it all"
    rows = [(i, t) for i, t in cases if i is not None and i != 7]
    rows += [(50 + k, prose(80 + k, 20 + k)) for k in range(6)] + [(60, prose(90, 24 - 4)), (61, prose(120, 77) + " " + passage), (62, prose(80, 20))]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'en' AS lang", "'src0' AS source", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, passage), (2, "never seen anywhere in any document of this small table at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    good = [(i, t) for i, t in rows if quality_test.verdict(t)[1]]
    firsts = {c for _, _, c in simhash_test.brute(good)}
    single = [(i, t) for i, t in good if i in firsts]
    clean = [(i, t) for i, t in single if not bench_test.brute([(i, t)], items)[0][5]]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert 61 in dict(single) and 61 not in dict(clean) and 62 not in firsts

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)
