import math
import random

import pytest

from covlattice.streaming import runs

SCHEMA = "run string, epoch int, pred double, target double"


def reports_of(rows, patience):
    """Every epoch but the last of a run, by hand."""
    out = []
    for run in sorted({r[0] for r in rows}):
        best, bad, stop = math.inf, 0, None
        epochs = sorted({e for r, e, *_ in rows if r == run})
        for e in epochs[:-1]:
            pairs = [(p, t) for r, x, p, t in rows if r == run and x == e]
            n, err = len(pairs), [p - t for p, t in pairs]
            mse, mean = sum(x * x for x in err) / n, sum(t for _, t in pairs) / n
            bad = 0 if mse < best else bad + 1
            best = min(best, mse)
            stop = stop if stop is not None or bad < patience else e
            out.append((run, e, n, mse, sum(map(abs, err)) / n, 1 - mse * n / sum((t - mean) ** 2 for _, t in pairs), best, bad, stop))
    return out


@pytest.mark.parametrize("hot", [1, 40])
def test_runs_over_restarts(spark, tmp_path, hot):
    """Two starts of the stream, the second with late rows: state goes on, an epoch is reported once."""
    r = random.Random(hot)
    rows = [(f"r{k}", e, r.random(), r.random()) for k in range(4) for e in range(12) for _ in range(5 * (hot if k == 0 else 1))]
    first, second = [x for x in rows if x[1] < 6], [x for x in rows if x[1] >= 6]
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for part, late in ((first, []), (second, [("r1", 2, 5.0, 0.0)])):
        odd = [(None, 1, 0.5, 0.5), ("r0", None, 0.5, 0.5), ("r0", 3, None, 0.5), ("r0", 3, 0.5, float("nan"))]
        spark.createDataFrame(part + late + odd, SCHEMA).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = runs.write_reports(runs.run_reports(stream, patience=2), out, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = reports_of(rows, 2)
    assert len(got) == len(want) == 44
    for a, b in zip(got, want):
        assert a[:3] + a[7:] == b[:3] + b[7:] and a[3:7] == pytest.approx(b[3:7])
