"""Metrics and early stopping of training runs on a stream, kept as state by run.

Rows (run, epoch, pred, target) are reduced to sums by run and epoch where they
are read; sums merge, so a run with a third of all rows is a few rows for each
task.  The state of a run is one row: the sums of the epoch under way, the best
value so far and the epochs since.  An epoch ends when a row of a later one
comes; it is then reported, once, and never again: later rows of it are late and
left out.  The state store keeps the state through restarts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

SUMS = ["n", "e1", "e2", "t1", "t2"]
_PARTIAL = "run string, epoch int, n long, e1 double, e2 double, t1 double, t2 double"
#: Of the state: the epoch under way and its sums, then what the epochs before it left.
_STATE = StructType(
    [StructField("epoch", IntegerType()), StructField("n", LongType()), *(StructField(c, DoubleType()) for c in SUMS[1:]),
     StructField("best", DoubleType()), StructField("bad", IntegerType()), StructField("stop", IntegerType())]
)
REPORT = "run string, epoch int, n long, mse double, mae double, r2 double, best double, bad int, stop_epoch int"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def partial_sums(rows: DataFrame) -> DataFrame:
    """(run, epoch, sums) of each batch of ``rows`` (run, epoch, pred, target); rows without a number at either end go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, epochs = batch.column("run").to_pylist(), batch.column("epoch").to_pylist()
            at: dict[tuple, int] = {}
            group = np.array([at.setdefault(k, len(at)) for k in zip(runs, epochs)], np.int64)
            p, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pred", "target"))
            sums = [np.bincount(group, w, len(at)) for w in (np.ones(len(t)), np.abs(p - t), (p - t) ** 2, t, t * t)]
            columns = [pa.array([k[0] for k in at], pa.string()), pa.array([k[1] for k in at], pa.int32()), pa.array(sums[0].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums[1:])], names=["run", "epoch", *SUMS])

    chosen = rows.select(F.col("run").cast("string"), F.col("epoch").cast("int"), F.col("pred").cast("double"), F.col("target").cast("double"))
    sound = F.col("run").isNotNull() & F.col("epoch").isNotNull()
    for c in ("pred", "target"):
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c)
    return chosen.where(sound).mapInArrow(run, _PARTIAL)


class RunProcessor(StatefulProcessor):
    """Merges the sums of a run, closes its epochs and counts those that do not improve."""

    def __init__(self, patience: int, min_delta: float) -> None:
        self.patience, self.min_delta = patience, min_delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get()
        now = list(held) if held else None
        out = []
        for row in sorted(rows, key=lambda r: r["epoch"]):
            if now and row["epoch"] < now[0]:
                continue  # late
            if now and row["epoch"] > now[0]:
                out.append(self._close(key[0], now))
                now[:6] = [row["epoch"], 0, 0.0, 0.0, 0.0, 0.0]
            now = now or [row["epoch"], 0, 0.0, 0.0, 0.0, 0.0, math.inf, 0, None]
            for k, c in enumerate(SUMS, 1):
                now[k] += row[c]
        if now:
            self.state.update(tuple(now))
        yield from out

    def _close(self, run: str, now: list) -> Row:
        epoch, n, e1, e2, t1, t2, best, bad, stop = now
        mse, spread = e2 / n, t2 - t1 * t1 / n
        r2 = 1 - e2 / spread if spread > 1e-8 else float(e2 <= 1e-8)
        if mse < best - self.min_delta:
            best, bad = mse, 0
        else:
            bad += 1
        if stop is None and bad >= self.patience:
            stop = epoch
        now[6:] = [best, bad, stop]
        return Row(run=run, epoch=epoch, n=n, mse=mse, mae=e1 / n, r2=r2, best=best, bad=bad, stop_epoch=stop)

    def close(self) -> None:
        pass


def run_reports(rows: DataFrame, patience: int = 10, min_delta: float = 0.0) -> DataFrame:
    """``REPORT`` of every epoch of a stream that has ended: its metrics, the best error so far, and where its run should stop."""
    grouped = partial_sums(rows).groupBy("run")
    return grouped.transformWithState(RunProcessor(patience, min_delta), StructType.fromDDL(REPORT), "append", "none")


def write_reports(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the reports to Parquet until the input is used up; state with typed columns needs the RocksDB store."""
    spark = reports.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return reports.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
