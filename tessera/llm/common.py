"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import numbered as numbered

#: A word of the contracts: what stands between ASCII white space (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each (one longer text alone), so that memory stays bounded."""
    sizes = np.diff(offsets_of(batch.column(column)))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def offsets_of(array: pa.Array) -> np.ndarray:
    """The n + 1 byte offsets of a string array; null texts have no bytes."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)


#: What operators keep in a Python worker between tasks, by name, as functions that drop it.
KEPT: dict[str, Callable[[], None]] = {}


def drop_kept(uses: str | None) -> None:
    """Workers outlive an operator: one that turns to another drops what the last one remembered."""
    dropped = [drop() for name, drop in KEPT.items() if name != uses]
    if dropped:
        gc.collect()


def map_slices(df: DataFrame, column: str, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, uses: str | None = None) -> DataFrame:
    """mapInArrow over slices of bounded bytes; `function` gives None for nothing. uses: what it keeps in the worker (see KEPT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(uses)
        for batch in batches:
            for part in slices(batch, column):
                if part.num_rows and (out := function(part)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under private names, so that further columns of the caller can't clash."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def broadcast_if_small(staged: DataFrame, most: int = 20_000) -> DataFrame:
    """Marks a staged frame for broadcast if its counted rows allow it; else it joins by a shuffle."""
    return F.broadcast(staged) if staged.limit(most + 1).count() <= most else staged
