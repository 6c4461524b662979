"""Positional and time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.binned import bin_of, looking_back, own_rows, running


def tumbling(rows: DataFrame, at: str, size: int, by: Sequence[str], aggs: Sequence[Column], origin: int = 1) -> DataFrame:
    """by, start, end and aggs of windows [start, start + size - 1] from `origin` on."""
    w = F.floor((F.col(at) - origin) / size)
    return rows.groupBy(*by, w.alias("_w")).agg(*aggs).withColumn("start", F.col("_w") * size + origin).withColumn("end", F.col("start") + size - 1).drop("_w")


def hopping(rows: DataFrame, at: str, size: int, shift: int, by: Sequence[str], aggs: Sequence[Column], origin: int = 1) -> DataFrame:
    """Windows starting at origin, origin + shift, ...: each row is sent to the at most ceil(size / shift) windows that hold it."""
    first = F.greatest(F.lit(0), F.ceil((F.col(at) - origin - size + 1) / shift)).cast("long")
    last = F.floor((F.col(at) - origin) / shift).cast("long")
    spread = rows.filter(F.col(at) >= origin).filter(first <= last).withColumn("_w", F.explode(F.sequence(first, last)))
    return spread.groupBy(*by, "_w").agg(*aggs).withColumn("start", F.col("_w") * shift + origin).withColumn("end", F.col("start") + size - 1).drop("_w")


def sliding(rows: DataFrame, at: str, size: int, by: Sequence[str], value: str, function=F.sum, name: str = "value") -> DataFrame:
    """`function` over the `size` rows that end at each row; null before a window is full."""
    both, w = looking_back(rows, by, at, size - 1) if size > 1 else (rows.withColumn("_guest", F.lit(False)).withColumn("_b", F.lit(0)), Window.partitionBy(*by).orderBy(at))
    w = w.rowsBetween(-(size - 1), 0)
    full = F.count(F.lit(1)).over(w) == size
    return own_rows(both.withColumn(name, F.when(full, function(F.col(value)).over(w))))


def sessions(rows: DataFrame, at: str, gap: int, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Runs of rows no further apart than `gap`: start, end and aggs."""
    both, w = looking_back(rows, by, at, 1)
    new = F.lag(at).over(w).isNull() | (F.col(at) - F.lag(at).over(w) > gap)
    flagged = own_rows(both.withColumn("_new", new.cast("int")))
    numbered = running(flagged, by, [at], {"_s": F.col("_new")}, bin_of(flagged, at))
    return numbered.groupBy(*by, "_s").agg(F.min(at).alias("start"), F.max(at).alias("end"), *aggs).drop("_s")


def split_windows(lengths: DataFrame, size: int, overlap: int = 0, name: str = "length") -> DataFrame:
    """start and end of the windows that cut sequences of given lengths, clipped at their ends; they start at 1, 1 + size - overlap, ..."""
    shift = size - overlap
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col(name), F.lit(1)).cast("long"), F.lit(shift).cast("long")))
    return lengths.withColumn("start", starts).withColumn("end", F.least(F.col("start") + size - 1, F.col(name)))
