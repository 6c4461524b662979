"""Window functions over long keys, bin by bin.

A window over a whole key sorts all of its rows in one task. Here a key's rows are cut into bins of their order; each bin is
sorted on its own, and what it needs of the bins before it is told by a row for each bin: a total for running sums, the last
few rows for windows that look back. So only bins are sorted by key, never a key's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from tessera.operators.intervals import BIN


def bin_of(rows: DataFrame, at: str, width: int = BIN) -> Column:
    """Bins in the order of a column: ranges of a number, days of a time; other kinds are one bin."""
    kind = rows.schema[at].dataType
    if isinstance(kind, NumericType):
        return F.floor(F.col(at) / width).cast("long")
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_date(F.to_date(at)).cast("long")
    return F.lit(0).cast("long")


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: dict[str, Column], bins: Column) -> DataFrame:
    """rows with sums of `values` over all rows of the key up to each one; bins: a column that never falls along the order."""
    held = rows.withColumn("_b", bins)
    for name, value in values.items():
        held = held.withColumn(f"_v_{name}", F.coalesce(value, F.lit(0)))
    totals = held.groupBy(*by, "_b").agg(*[F.sum(f"_v_{n}").alias(n) for n in values])
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_b", F.lag("_b").over(Window.partitionBy(*by).orderBy("_b")).isNotNull().alias("_later"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_v_{n}") for n in values])
    # a later bin's first row is a guest with the sums before it: no join brings all rows together again
    both = held.withColumn("_guest", F.lit(False)).unionByName(before.filter("_later").drop("_later").withColumn("_guest", F.lit(True)), allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc("_guest"), *order).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in rows.columns if c not in values]
    return both.select(*kept, "_guest", *[F.sum(f"_v_{n}").over(inside).alias(n) for n in values]).filter(~F.col("_guest")).drop("_guest")


def looking_back(rows: DataFrame, by: Sequence[str], at: str, k: int, width: int = BIN) -> tuple[DataFrame, Window]:
    """rows with, for each bin, a guest's copy (_guest) of the last k rows before it, and the window of a bin's rows in order.

    What looks back at most k rows is right for all but the guests, which are to be filtered out afterwards.
    """
    held = rows.withColumn("_b", bin_of(rows, at, width))
    from_end = Window.partitionBy(*by, "_b").orderBy(F.desc(at))
    ends = held.withColumn("_k", F.row_number().over(from_end)).filter(F.col("_k") <= k)
    last = ends.groupBy(*by, "_b").agg(F.collect_list(F.struct("_b", "_k", F.struct(*rows.columns).alias("_row"))).alias("_last"))  # k rows at most
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(-k, -1)

    def later_first(x: Column, y: Column) -> Column:
        return F.when(x["_b"] != y["_b"], F.when(x["_b"] > y["_b"], -1).otherwise(1)).otherwise(F.when(x["_k"] < y["_k"], -1).when(x["_k"] > y["_k"], 1).otherwise(0))

    back = last.select(*by, "_b", F.slice(F.array_sort(F.flatten(F.collect_list("_last").over(w)), later_first), 1, k).alias("_last"))
    guests = back.select("_b", F.explode("_last").alias("_g")).select("_g._row.*", "_b", F.lit(True).alias("_guest"))
    both = held.withColumn("_guest", F.lit(False)).unionByName(guests)
    return both, Window.partitionBy(*by, "_b").orderBy(at)


def own_rows(both: DataFrame, *columns: str | Column) -> DataFrame:
    """Without guests and bins."""
    kept = both.filter(~F.col("_guest"))
    return kept.select(*columns) if columns else kept.drop("_b", "_guest")
