"""Streaming forms: watermarked windows, running merges and forward filtering with state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.hmm import Hmm, logsum


def windowed_counts(stream: DataFrame, at: str, size: str, slide: str | None = None, late: str = "10 minutes", by: Sequence[str] = (), aggs: Sequence[Column] = ()) -> DataFrame:
    """Event-time windows (tumbling, or hopping with a slide); rows later than `late` behind the watermark go."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    out = stream.withWatermark(at, late).groupBy(window, *by).agg(*(aggs or [F.count(F.lit(1)).alias("n")]))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def session_windows(stream: DataFrame, at: str, gap: str, late: str = "10 minutes", by: Sequence[str] = (), aggs: Sequence[Column] = ()) -> DataFrame:
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(*(aggs or [F.count(F.lit(1)).alias("n")]))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in out.columns if c != "session_window"])


def deduplicated(stream: DataFrame, at: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def tuple_counts(stream: DataFrame, key: str) -> DataFrame:
    """Running counts of distinct keys, the streaming form of the tuple table (update or complete mode)."""
    return stream.groupBy(F.col(key).alias("tuple")).agg(F.count(F.lit(1)).alias("cnt"))


def forward_filter(stream: DataFrame, model: Hmm, key: str, order: str, emission: str) -> DataFrame:
    """key, order and filtered state probabilities of each row: one vector of states per key is all that is kept.

    Rows of a key are taken in `order` inside a batch; batches are taken to come in order.
    """
    t, b, _ = model.logs()
    n = model.n
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        v = np.array(state.get[0]) if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for e in rows[emission]:
            e = np.asarray(e, float)
            v = (b if v is None else logsum(v[:, None] + t, 0)) + e
            v = v - logsum(v, 0)
            out.append(np.exp2(v))
        state.update((v.tolist(),))
        yield pd.DataFrame({key: keys[0], order: rows[order].to_numpy(), "filtered": out})

    assert n == len(b)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, filtered array<double>", "v array<double>", "append", "NoTimeout")


def run_once(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now and reads its result, which is written as Parquet and never passes the driver.

    append: what the stream gives; complete: what it gives after its last batch.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"mode {mode} gives no one result")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
    spark = stream.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):  # not one batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(path)
