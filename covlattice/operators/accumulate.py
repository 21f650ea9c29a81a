"""Vectors accumulated by key: partial sums in the task that reads a row, merged once after a shuffle.

A row of an accumulator is one array of doubles, laid out by :class:`Layout`:
places that are summed, places of which the largest counts, and softmax groups
of (largest score, sum of exponentials, weighted sum of vectors), which merge
like sums once both are about the same maximum.  A key that very many rows have
is one accumulator for each task that meets it, and the merge streams those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Accumulators that a task holds before it sends them on.
HELD = 4096


class Layout(NamedTuple):
    """``sums`` places, ``tops`` places, and ``attentions`` softmax groups over vectors of ``dims`` places."""

    sums: int
    tops: int
    attentions: int
    dims: int

    @property
    def width(self) -> int:
        return self.sums + self.tops + self.attentions * (2 + self.dims)

    def split(self, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sums, tops, and of the softmax groups the scores (rows, groups), totals and vectors (rows, groups, dims)."""
        at = self.sums + self.tops
        groups = acc[:, at:].reshape(len(acc), self.attentions, 2 + self.dims)
        return acc[:, : self.sums], acc[:, self.sums : at], groups[:, :, 0], groups[:, :, 1], groups[:, :, 2:]

    def join(self, sums: np.ndarray, tops: np.ndarray, score: np.ndarray, total: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        groups = np.concatenate([score[:, :, None], total[:, :, None], mixed], 2)
        return np.concatenate([sums, tops, groups.reshape(len(sums), -1)], 1)

    def merge(self, acc: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row for each run of rows that begins at ``starts``."""
        sums, tops, score, total, mixed = self.split(acc)
        best = np.maximum.reduceat(score, starts)
        run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(acc)]))
        scale = np.exp(np.where(np.isneginf(score), -np.inf, score - best[run]))
        return self.join(
            np.add.reduceat(sums, starts), np.maximum.reduceat(tops, starts), best,
            np.add.reduceat(total * scale, starts), np.add.reduceat(mixed * scale[:, :, None], starts),
        )


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row that rows of the same keys share; a null is a key as well."""
    out = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        coded = pc.dictionary_encode(column, null_encoding="encode")
        out = np.unique(out * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True)[1]
    return out


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)


def _rows(columns: list[pa.Array], names: list[str], acc: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(acc) + 1, dtype=np.int32) * acc.shape[1])
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(acc.ravel()))], names=[*names, "acc"])


def accumulate(rows: DataFrame, keys: list[str], layout: Layout, parts: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(keys, acc): ``parts`` gives a row of an accumulator for every row of a batch; rows of a key are merged.

    Keys may be null.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def merged(columns: list[pa.Array], acc: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
        codes = _codes(columns)
        order = np.argsort(codes, kind="stable")
        starts = _starts(codes[order])
        return [c.take(pa.array(order[starts])) for c in columns], layout.merge(acc[order], starts)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[pa.Array], np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(merged([batch.column(k) for k in keys], parts(batch)))
            if sum(len(acc) for _, acc in held) > 2 * HELD:
                if len(held) > 1:
                    held = [merged([pa.concat_arrays(c) for c in zip(*(columns for columns, _ in held))], np.concatenate([acc for _, acc in held]))]
                if len(held[0][1]) > HELD:
                    yield _rows(held[0][0], keys, held[0][1])
                    held = []
        for columns, acc in held:
            yield _rows(columns, keys, acc)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[list[pa.Array], np.ndarray] | None = None  # a key whose rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            acc = batch.column("acc").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, layout.width)
            if last:
                columns = [pa.concat_arrays([a, b]) for a, b in zip(last[0], columns)]
                acc = np.concatenate([last[1], acc])
            starts = _starts(_codes(columns))
            columns, acc = [c.take(pa.array(starts)) for c in columns], layout.merge(acc, starts)
            last = [c.slice(len(c) - 1) for c in columns], acc[-1:]
            if len(acc) > 1:
                yield _rows([c.slice(0, len(c) - 1) for c in columns], keys, acc[:-1])
        if last:
            yield _rows(*last[:1], keys, last[1])

    begun = rows.mapInArrow(begin, f"{kinds}, acc array<double>")
    return begun.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, f"{kinds}, acc array<double>")
