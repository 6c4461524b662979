"""Answers for the keys of blocks: packed columns that Spark shuffles by key and hands back to the blocks.

A block is a row that holds some megabytes of text in a packed form. It asks for the keys that occur in it, each once,
sorted and cut into buckets by their leading bits; a bucket meets in one task, which adds up what all blocks say of a
key and answers every block in the order of its own keys, so that no key travels back. Keys are well-mixed 64-bit
integers: a frequent key is one entry of each block at most, and no bucket is larger than its share of the entries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose keys meet in one bucket, and the fewest leading bits that part keys.
BUCKET_BYTES = 8 << 20
LEAST_BITS = 6


def bucket_bits(text_bytes: int) -> int:
    return max(LEAST_BITS, math.ceil(math.log2(max(1, text_bytes / BUCKET_BYTES))))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One well-mixed key for each pair of keys; the order of the pair counts."""
    with np.errstate(over="ignore"):
        x = np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.asarray(b, np.uint64) ^ np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
        return spread(x)


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose leading bits depend on all bits."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        for factor in _FACTORS:
            x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
        return x ^ (x >> np.uint64(32))


def unspread(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        for factor in reversed(_FACTORS):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(pow(factor, -1, 1 << 64))
        return x ^ (x >> np.uint64(32))


_FACTORS = (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as planes of bytes, only as many as the largest needs: their zeros compress."""
    values = np.ascontiguousarray(values, "<u8")
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(raw: bytes | None) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as packed differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes | None) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def squeezed(raw: bytes) -> bytes:
    return pa.compress(raw, "zstd", asbytes=True) if raw else b""


def expanded(raw: bytes | None) -> bytes:
    return zstandard.decompress(raw) if raw else b""


def pack_doubles(values: np.ndarray) -> bytes:
    """Doubles as compressed planes of bytes: many are zero or one."""
    return squeezed(np.ascontiguousarray(values, "<f8").view(np.uint8).reshape(-1, 8).T.tobytes())


def doubles(raw: bytes | None) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expanded(raw), np.uint8).reshape(8, -1).T).view("<f8").ravel()


def parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted keys and where each one's keys stand."""
    ends = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    ends = np.concatenate([[0], ends, [len(keys)]])
    for bucket in np.flatnonzero(np.diff(ends)):
        yield int(bucket), slice(int(ends[bucket]), int(ends[bucket + 1]))


def meet(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of several lists; for each entry of the joined lists its key's place; each key's first entry; where the lists end."""
    ends = np.cumsum([0, *map(len, keys)])
    place, distinct = pd.factorize(np.concatenate(keys) if keys else np.zeros(0, np.uint64))
    first = np.empty(len(distinct), np.int64)
    first[place[::-1]] = np.arange(len(place))[::-1]
    return distinct, place, first, ends


def sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of integers (below 2^53 each) by place."""
    return np.bincount(place, values.astype(np.float64), n).astype(np.uint64)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about `most` bytes of their binary fields."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def answered(asked: DataFrame, answer: Callable[[list[dict]], Iterable[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """The rows of each bucket, in the order of their blocks, through `answer`, which gives rows of `schema`."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        return pa.Table.from_batches(list(in_batches(answer(rows), schema)), schema)

    return asked.groupBy("bucket").applyInArrow(run, ddl)


def by_block(answers: DataFrame, *columns: str, name: str) -> DataFrame:
    """One row for each block: the answers of its buckets in their order, as an array of structs."""
    rows = F.sort_array(F.collect_list(F.struct("bucket", *columns)))
    return answers.filter(F.col("block").isNotNull()).groupBy("block").agg(rows.alias(name))
