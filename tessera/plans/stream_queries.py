"""Streaming queries, run over the events that are there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.runtime import own, shared_dir, table
from tessera.streaming import streams


def _events(spark, d):
    """The table read as a stream of files."""
    schema = table(spark, d, "events").schema
    one = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if not d.startswith("viewfs") else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    return one.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, stream, mode):
    at = f"{shared_dir(spark)}/tessera-stream-{uuid.uuid4().hex}"
    return streams.run_once(stream, own(f"{at}-out"), mode, own(f"{at}-state"))


@query("stream_window_counts", """SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL""")
def stream_window_counts(spark, d):
    s = streams.windowed_counts(_events(spark, d), "ts", "1 hour", late="365 days", by=["event_type"], aggs=[F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
    return _run(spark, s, "complete").select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("stream_tuple_counts", "SELECT event_type AS tuple, count(*) AS cnt FROM events GROUP BY event_type")
def stream_tuple_counts(spark, d):
    return _run(spark, streams.tuple_counts(_events(spark, d), "event_type"), "complete")


def _filter_sql() -> str:
    from tessera.plans.sequence_queries import EMISSION_SQL

    log_sum = lambda x, y: f"greatest({x}, {y}) + log2(1 + pow(2, -abs(({x}) - ({y}))))"
    return f"""WITH RECURSIVE s AS (SELECT user_id, event_id, event_type AS sym, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
e AS (SELECT user_id, event_id, pos, {EMISSION_SQL} AS e FROM s),
f AS (SELECT user_id, event_id, pos, log2(0.6) + e[1] AS a, log2(0.4) + e[2] AS b FROM e WHERE pos = 1
UNION ALL SELECT e.user_id, e.event_id, e.pos, {log_sum("f.a + log2(0.9)", "f.b + log2(0.2)")} + e.e[1], {log_sum("f.a + log2(0.1)", "f.b + log2(0.8)")} + e.e[2]
FROM f JOIN e ON e.user_id = f.user_id AND e.pos = f.pos + 1)
SELECT user_id, event_id, round(1 / (1 + pow(2, b - a)), 6) AS p0 FROM f"""


@query("stream_forward_filter", _filter_sql())
def stream_forward_filter(spark, d):
    import numpy as np

    from tessera.plans.sequence_queries import CHAIN, EMISSION

    other = F.array(*[F.lit(float(np.log2(p))) for p in (0.05, 0.1)])
    table_ = F.create_map(*[x for k, v in EMISSION.items() for x in (F.lit(k), F.array(*[F.lit(float(np.log2(p))) for p in v]))])
    rows = _events(spark, d).select("user_id", "event_id", F.coalesce(F.element_at(table_, F.col("event_type")), other).alias("emission"))
    out = _run(spark, streams.forward_filter(rows, CHAIN, "user_id", "event_id", "emission"), "append")
    return out.select("user_id", "event_id", F.round(F.col("filtered")[0], 6).alias("p0"))
