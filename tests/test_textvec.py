import numpy as np
import pytest

from covlattice.operators import textvec


def test_vectors_are_near_where_texts_are(spark):
    rows = [(0, "load the register from memory"), (1, "loads the registers from memory"), (2, "an unrelated sentence about weather"), (3, None), (4, "?! ..."), (5, "")]
    table = spark.createDataFrame(rows, "id int, text string").repartition(3)
    got = {r.id: np.array(r.vector) for r in textvec.text_vectors(table, 64).collect()}
    assert all(np.isclose(np.linalg.norm(got[k]), 1) for k in (0, 1, 2)) and not any(got[k].any() for k in (3, 4, 5))
    assert got[0] @ got[1] > 0.6 > 0.35 > abs(got[0] @ got[2])
    assert np.allclose(got[0], textvec.encode_texts([rows[0][1]], 64)[0])
    assert not np.allclose(got[0], textvec.encode_texts([rows[0][1]], 64, seed=1)[0])


def test_projection_is_orthonormal():
    m = textvec.projection(32, 5)
    assert np.allclose(m.T @ m, np.eye(32))
    with pytest.raises(ValueError):
        textvec.projection(0)


def test_chunks_are_halved_when_memory_is_short(monkeypatch):
    texts = [f"word{k} and word{k + 1}" for k in range(40)]
    want, zeros, sizes = textvec.encode_texts(texts, 16), np.zeros, []

    def short(shape, *more):
        if isinstance(shape, tuple) and shape[-1] == textvec.BUCKETS:
            sizes.append(shape[0])
            if shape[0] > 5:
                raise MemoryError
        return zeros(shape, *more)

    monkeypatch.setattr(textvec.np, "zeros", short)
    assert np.allclose(textvec.encode_texts(texts, 16, chunk=32), want) and sizes[:4] == [32, 16, 8, 4]
    monkeypatch.setattr(textvec, "BUCKETS", 4096)
    monkeypatch.setattr(textvec.np, "zeros", lambda shape, *m: (_ for _ in ()).throw(MemoryError()) if isinstance(shape, tuple) and shape[-1] == 4096 else zeros(shape, *m))
    with pytest.raises(MemoryError):
        textvec.encode_texts(texts[:2], 16)
