"""The driver tables as the engine's data: intervals, symbol sequences, tuples, trees and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import table

#: The same views as SQL for the second engine, to be put before a query as common table expressions.
FEATS = """feats AS (
  SELECT event_id, user_id AS seqname, event_type AS feature, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS start,
         CAST(epoch_us(ts) // 1000000 AS BIGINT) + CAST(floor(value * 3600 + 0.5) AS BIGINT) AS "end",
         value AS score, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(event_id % 3 AS INTEGER) AS frame
  FROM events)"""
SYMBOLS = """symbols AS (
  SELECT user_id AS seq, event_type AS sym, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"""
TUPLES = """cols AS (
  SELECT l_orderkey AS aln, l_returnflag || l_linestatus || CASE WHEN l_quantity > 40 THEN '-' WHEN l_quantity > 20 THEN 'H' ELSE 'L' END AS col,
         CAST(l_quantity AS INTEGER) % 3 AS cat,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax) AS pos
  FROM lineitem)"""
EDGES = """edges AS (
  SELECT 'r' || r_regionkey AS node, 'root' AS parent, 1.0::DOUBLE AS len FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey % 5 + 1 AS DOUBLE) FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, CAST(s_suppkey % 7 + 1 AS DOUBLE) FROM supplier)"""


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of users' events: from the event's second on for as many hours as its value."""
    e = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")  # whatever the session's time zone
    rows = e.select("event_id", F.col("user_id").alias("seqname"), F.col("event_type").alias("feature"), start.alias("start"), (start + F.floor(F.col("value") * 3600 + 0.5)).alias("end"), F.col("value").alias("score"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("event_id") % 3).cast("int").alias("frame"), F.col("props").alias("attribute"))
    return rows


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by user, numbered from 1 in time."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("seq"), F.col("event_type").alias("sym"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))


#: The order of an order's columns.
PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")


def _column():
    q = F.when(F.col("l_quantity") > 40, "-").when(F.col("l_quantity") > 20, "H").otherwise("L")
    return F.concat("l_returnflag", "l_linestatus", q)


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-row columns of orders: return flag, line status and a quantity class ('-' is a gap)."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*PLACE)
    return li.select(F.col("l_orderkey").alias("aln"), _column().alias("col"), (F.col("l_quantity").cast("int") % 3).alias("cat"), F.row_number().over(w).alias("pos"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aln and all its columns in order, as an array: lines are sorted inside their order, by no window over all of them."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("aln"), F.struct(*PLACE, _column().alias("col")).alias("x"))
    kept = lines.repartition("aln").groupBy("aln").agg(F.sort_array(F.collect_list("x")).alias("x"))  # dealt first: partial lists would only be moved whole
    return kept.select("aln", F.col("x.col").alias("cols"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy of regions, nations and suppliers as a tree of edges."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    return (
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.lit(1.0).alias("len"))
        .unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), (F.col("n_nationkey") % 5 + 1).cast("double").alias("len")))
        .unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("len")))
    )
