"""Reproducible shuffle into shards by a Feistel permutation of the global row numbers.

A row's number is its place in the order of (doc_id, checksum, size); a balanced Feistel network over the smallest
square-like domain that holds all numbers, walked on until it lands inside (cycle walking), maps it to a position.
Position p belongs to shard p mod n and is slot p div n there, so shard, slot and, backwards, the row number of any
slot can be computed from (rows, seed) alone, without looking at data.

Defined results: a null text has no bytes (size 1, checksum 0); rows with a null doc_id come first in the order and
take part like any other; repeated rows get positions of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, pick
from tessera.runtime import stage

SHARDS = 8
SEED = 0x5EED
ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix) keyed by an odd multiple."""
    z = x.astype(np.uint64) + np.uint64(key)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed], np.uint64), (r + 1) * 0x9E3779B97F4A7C15 % 2**64)[0]) for r in range(ROUNDS)]


def _sides(rows: int) -> tuple[int, int]:
    """a * b >= rows with both sides near the square root: the domain exceeds rows by less than 2a + 1."""
    a = max(1, isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def permute(numbers: np.ndarray, rows: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of range(rows) at `numbers`, or its inverse.

    Alternating Feistel rounds on (left < a, right < b): each adds a keyed hash of one half to the other, modulo its
    side. Values outside range(rows) are sent through again until they fall inside.
    """
    a, b = (np.uint64(x) for x in _sides(rows))
    out = np.asarray(numbers, dtype=np.uint64).copy()
    keys = list(enumerate(_keys(seed)))
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x // b, x % b
            for r, key in reversed(keys) if inverse else keys:
                half, side, other = (left, a, right) if r % 2 == 0 else (right, b, left)
                moved = _mix(other, key) % side
                half = (half + (side - moved if inverse else moved)) % side
                left, right = (half, right) if r % 2 == 0 else (left, half)
            out[todo] = left * b + right
            todo = todo[out[todo] >= np.uint64(rows)]
    return out.astype(np.int64)


def row_number_at(shard: int, slot: int, rows: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The global row number whose document lies in a slot, from the counts alone."""
    return int(permute(np.array([slot * shards + shard]), rows, seed, inverse=True)[0])


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row (see the module)."""
    raw = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    slim = pick(docs, doc_id=id_col, size=(F.length(raw) + 1).cast("long"), text_crc32=F.crc32(raw))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    rows = numbered(stage(slim, "shard-sizes"), order, "row_number")
    total = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]

    @F.pandas_udf("long")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(permute(part.to_numpy(), total, seed))

    at = rows.withColumn("_p", place("row_number"))
    return at.select("doc_id", "size", "text_crc32", "row_number", F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))


def op2_feistel_shards(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
