import hashlib
import random
import zlib

import numpy as np
import pytest

from covlattice.llm import bpe, tokencount, tokenfiles, wordbpe
from covlattice.llm.wordbpe import WordEncoder


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def own(vocabulary):
    return WordEncoder(vocabulary("word_bpe_49k.json"))


ALPHABET = list("abcdeABC'stre 1239.,!?#-_\t\n\r\x0b\x0c\x1c\x85\xa0\x00") + [
    "é", "É", "ß", "İ", "ı", "ñ", "ª", "²", "½", "́", "中", "😀", "Σ", "ς", "<|endoftext|>", "<|startoftext|>", "​", " ", "ﬁ", "ſ", "Ǆ", "'ll", "'RE", "ŉ", "한",
]


def test_encoding_is_the_librarys(own, library):
    r = random.Random(1)
    texts = ["".join(r.choices(ALPHABET, k=r.randint(0, 40))) for _ in range(4000)] + ["zqxjkwvq" * 500, "ab" * 2000, "é" * 999, ""]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), np.uint32).tolist() == ids
        assert own.strings(text) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))


def test_forgotten_runs_are_encoded_again(own, vocabulary, monkeypatch):
    monkeypatch.setattr(wordbpe, "REMEMBERED_BYTES", 700)
    small = WordEncoder(vocabulary("word_bpe_49k.json"))
    for text in ("one two three one four five one six two " * 3, "seven one eight", "one one", ""):
        assert small.ids(text) == own.ids(text) and small.strings(text) == own.strings(text)


def test_memory_is_bounded_in_bytes(vocabulary, library):
    """A megabyte without a break, and many different long runs, of several scripts."""
    own = WordEncoder(vocabulary("word_bpe_49k.json"))
    r = random.Random(5)
    han = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(330_000))
    for text in (han, "QmFzZTY0" * 125_000, "x" * 1_000_000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), np.uint32).tolist() == ids
    words = ["".join(r.choices("bcdfghjklmnpqrstvwxz", k=60)) for _ in range(2000)]
    han_words = [han[k : k + 50] for k in range(0, 300_000, 50)]
    for k in range(100):
        own.ids(" ".join(w[k % 60 :] + w[: k % 60] for w in words))
        own.strings(" ".join(w[k % 50 :] + w[: k % 50] for w in han_words[k * 60 : k * 60 + 60]))
    for memory in (own._ids, own._strings):
        held = sum(len(k) + len(v if isinstance(v, bytes) else "".join(v)) for k, v in memory.known.items())
        assert held <= memory.held <= wordbpe.REMEMBERED_BYTES + (8 << 20)
        assert all(len(k) <= wordbpe.LONGEST for k in memory.known)


def test_texts_in_pieces(own, library, monkeypatch):
    text = ("One two\nthree, " * 3000) + "y" * 700 + " end"
    assert "".join(wordbpe.pieces(text, 100)) == text and len(list(wordbpe.pieces(text, 100))) > 300
    want = library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(wordbpe.pieces, "__defaults__", (100,))
    assert np.frombuffer(own.ids(text), np.uint32).tolist() == want
    assert own.strings(text) == (" ".join(map(str, want)), library.decode(want, skip_special_tokens=False))


def test_boundaries_are_forced_and_cut_long_runs(own, library):
    data = ("zqxjkwvq" * 40).encode()
    assert len(own.cuts(data)) > 40
    han = "中文字典" * 50  # other scripts are cut as well
    assert len(own.cuts(han.encode())) > 40
    tokens = set(library.get_vocab())
    assert all(chr(data[i - 1]) + chr(data[i]) not in t for i in own.cuts(data) for t in tokens)


def test_encoding_query(docs, cases, vocabulary, library):
    got = bpe.encoding_digests(docs, vocabulary("word_bpe_49k.json")).collect()
    want = []
    for i, t in cases:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_ids_round_trip(docs, empty, vocabulary, library):
    path = vocabulary("word_bpe_49k.json")
    encoded = bpe.encode_documents(docs, path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.decode_documents(encoded, path).collect():
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert r.text == library.decode(ids, skip_special_tokens=False)
    assert bpe.encoding_digests(empty, path).count() == 0


def test_token_files(spark, docs, cases, vocabulary, library, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "PART_ROWS", 4)
    monkeypatch.setattr(tokenfiles, "SEGMENT_BYTES", 200)
    path = str(tmp_path / "t")
    tokenfiles.write_token_files(docs, path, vocabulary("word_bpe_49k.json"), end_id=2)
    got = tokenfiles.token_file_report(tokenfiles.read_token_files(spark, path)).collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (str(i), len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in cases
    )
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id is not None for r in order] == sorted(r.doc_id is not None for r in order)
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known)
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]
    few = tokenfiles.read_token_files(spark, path, only=[14, 8]).collect()
    assert sorted(r.doc_id for r in few) == [8, 14]


def test_token_files_of_one_hot_id(spark, vocabulary, library, tmp_path, monkeypatch):
    """An id, and null, that many documents have are dealt to several parts; the places stay gapless."""
    monkeypatch.setattr(tokenfiles, "PART_ROWS", 10)
    rows = [(7, f"text {k}") for k in range(60)] + [(None, f"none {k}") for k in range(40)] + [(k, f"own {k}") for k in range(30)]
    path = str(tmp_path / "h")
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokenfiles.write_token_files(made, path, vocabulary("word_bpe_49k.json"), end_id=2)
    parts = spark.read.parquet(f"{path}/segments").selectExpr("part", "explode(doc_ids) AS i").groupBy("part").agg({"i": "count", "*": "count"}).collect()
    assert max(r["count(1)"] for r in parts) < 40
    got = sorted(tokenfiles.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0)) and len(got) == len(rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = lambda t: np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), ids(t)) for i, t in rows)


def test_token_files_of_an_empty_table_and_of_another_dictionary(spark, empty, docs, vocabulary, tmp_path):
    path = str(tmp_path / "e")
    tokenfiles.write_token_files(empty, path, vocabulary("word_bpe_49k.json"), end_id=2)
    assert tokenfiles.read_token_files(spark, path).count() == 0
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles._unzipper(b"dictionary", "0" * 64)


def test_counts_are_the_librarys(docs, cases, empty, vocabulary):
    model = vocabulary("piece_bpe_32k.model")
    lib = tokencount.counter(model).lib
    got = tokencount.count_tokens(docs, model, limit=100).collect()
    want = [(i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 100) for i, t in cases]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(empty, model).count() == 0


def test_resynchronisation(vocabulary):
    count = tokencount.counter(vocabulary("piece_bpe_32k.model"))
    r = random.Random(2)
    letters = list("ab e   1.") + ["\n", "▁", "é", "中", "<s>", "😀", "\x00", "ﬁ", "\t"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 300))) for _ in range(500)]
    texts += [" " * 3000, "a" * 3000, "ab" * 1500, "中文字" * 700 + " ", "<0x0A>" * 300, "the cat sat " * 400]
    for text in texts:
        assert count.count(text, chunk=40, overlap=5) == len(count.lib.encode(text))


def test_a_boundary_inside_a_piece_is_not_proven(vocabulary):
    count = tokencount.counter(vocabulary("piece_bpe_32k.model"))
    assert not count.forced("t", "h") and not count.forced(" ", "t") and count.forced("中", " ")
