"""Markov chains and position weight matrices over symbol sequences (by, pos, sym)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.binned import looking_back, own_rows


def transitions(rows: DataFrame, by: Sequence[str] = ("seq",), order: int = 1) -> DataFrame:
    """from (the `order` symbols before, joined by |), to and cnt."""
    both, w = looking_back(rows.select(*by, "pos", "sym"), by, "pos", order)
    before = [F.lag("sym", i).over(w) for i in range(order, 0, -1)]
    pairs = both.select("_guest", F.concat(*[p for b in before for p in (F.lit("|"), b)][1:]).alias("from"), F.col("sym").alias("to"))
    return pairs.filter(~F.col("_guest") & F.col("from").isNotNull()).groupBy("from", "to").agg(F.count(F.lit(1)).alias("cnt"))


def transition_matrix(counts: DataFrame, pseudo: float = 0.0, states: Sequence[str] | None = None) -> DataFrame:
    """from, to, cnt and p: rows add up to 1; with pseudo-counts over all pairs of states."""
    if pseudo and states:
        grid = counts.sparkSession.createDataFrame([(a, b) for a in states for b in states], "`from` string, `to` string")
        counts = grid.join(counts, ["from", "to"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    total = F.sum(F.col("cnt") + pseudo).over(Window.partitionBy("from"))  # one row for each pair of states
    return counts.withColumn("p", (F.col("cnt") + pseudo) / total)


def path_loglik(rows: DataFrame, matrix: DataFrame, by: Sequence[str] = ("seq",)) -> DataFrame:
    """by and loglik: the sum of log2 p over the steps of each sequence; a step without a probability gives minus infinity."""
    both, w = looking_back(rows.select(*by, "pos", "sym"), by, "pos", 1)
    steps = own_rows(both.withColumn("from", F.lag("sym").over(w)).withColumn("to", F.col("sym")))
    logs = matrix.select("from", "to", F.log2("p").alias("_l"))
    met = steps.join(logs, ["from", "to"], "left")
    step = F.when(F.col("from").isNull(), 0.0).otherwise(F.coalesce("_l", F.lit(float("-inf"))))
    return met.groupBy(*by).agg(F.sum(step).alias("loglik"))


def _grams(texts: DataFrame, k: int, text: str, alphabet: str) -> DataFrame:
    """gram and cnt of all windows of k letters.

    Whole texts are counted in numpy, some millions of characters at a time, so that only each part's distinct grams are
    left to be added up; letters become numbers once, which is linear in the length.
    """
    letter = re.compile(alphabet)

    def counted(parts: list[str]) -> pa.RecordBatch:
        points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        kinds, codes = np.unique(points, return_inverse=True)
        good = np.array([letter.fullmatch(chr(c)) is not None for c in kinds.tolist()], bool)[codes]
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        n = max(0, len(points) - k + 1)
        fine = of[:n] == of[len(points) - n :] if n else np.zeros(0, bool)
        names = np.zeros(n, np.int64)
        for i in range(k):
            fine &= good[i : i + n]
            names = names * len(kinds) + codes[i : i + n]
            if i + 1 < k and len(kinds) ** (i + 2) >= 2**62:  # short numbers again, in the same order
                names = np.unique(names, return_inverse=True)[1]
        at = np.nonzero(fine)[0]
        _, first, counts = np.unique(names[at], return_index=True, return_counts=True)
        grams = ["".join(map(chr, points[s : s + k].tolist())) for s in at[first].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["gram", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for t in batch.column("t").to_pylist():
                if held and size + len(t) > 1 << 22:
                    yield counted(held)
                    held, size = [], 0
                held.append(t)
                size += len(t)
            if held:
                yield counted(held)

    lower = texts.select(F.lower(F.col(text)).alias("t")).filter(F.length("t") >= k)
    return lower.mapInArrow(run, "gram string, cnt long").groupBy("gram").agg(F.sum("cnt").alias("cnt"))


def kgram_model(texts: DataFrame, k: int, text: str = "text", alphabet: str = "[a-z]") -> DataFrame:
    """ord, context, sym, cnt and p for all orders 0..k of the letters of texts; a gram with other signs is left out."""
    grams = None
    for order in range(k + 1):
        one = _grams(texts, order + 1, text, alphabet).select(F.lit(order).alias("ord"), F.substring("gram", 1, order).alias("context"), F.substring("gram", order + 1, 1).alias("sym"), "cnt")
        grams = one if grams is None else grams.unionByName(one)
    return grams.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("ord", "context")))


def gram_counts(texts: DataFrame, k: int, text: str = "text", alphabet: str = "[a-z]") -> DataFrame:
    """gram and cnt of all windows of k letters."""
    return _grams(texts, k, text, alphabet)


def pwm_scan(rows: DataFrame, pwm: DataFrame, width: int, background: DataFrame | None = None, by: Sequence[str] = ("seq",), threshold: float | None = None) -> DataFrame:
    """by, pos and score: the sum of log2 weights (less those of the background) of the window that starts at each position.

    pwm: at (0-based), sym, p; background: sym, p. A symbol that the matrix lacks gives minus infinity. threshold is strict.
    """
    weights = pwm.select("at", "sym", F.log2("p").alias("_w"))
    if background is not None:
        weights = weights.join(background.select("sym", F.log2("p").alias("_b")), "sym").withColumn("_w", F.col("_w") - F.col("_b"))
    spread = rows.select(*by, "pos", "sym", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("at")).withColumn("pos", F.col("pos") - F.col("at")).filter(F.col("pos") >= 1)
    scored = spread.join(weights, ["at", "sym"], "left").groupBy(*by, "pos").agg(F.sum(F.coalesce("_w", F.lit(float("-inf")))).alias("score"), F.count(F.lit(1)).alias("_n"))
    full = scored.filter(F.col("_n") == width).drop("_n")
    return full if threshold is None else full.filter(F.col("score") > threshold)


def estimate_pwm(samples: DataFrame, pseudo: float = 0.0, alphabet: Sequence[str] = ()) -> DataFrame:
    """at, sym and p from aligned samples (at, sym)."""
    counts = samples.groupBy("at", "sym").agg(F.count(F.lit(1)).alias("cnt"))
    if pseudo and alphabet:
        grid = samples.select("at").distinct().withColumn("sym", F.explode(F.array(*[F.lit(a) for a in alphabet])))
        counts = grid.join(counts, ["at", "sym"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return counts.withColumn("p", (F.col("cnt") + pseudo) / F.sum(F.col("cnt") + pseudo).over(Window.partitionBy("at")))


def reverse_complement_pwm(pwm: DataFrame, width: int) -> DataFrame:
    return pwm.withColumn("at", width - 1 - F.col("at")).withColumn("sym", F.translate("sym", "ACGTacgt", "TGCAtgca"))


def confusion(pairs: DataFrame, truth: Column, called: Column) -> DataFrame:
    """tp, fp, fn, tn, sensitivity, specificity (as tp / called), correlation and approximate correlation of two labels."""
    t, c = truth.cast("boolean"), called.cast("boolean")
    n = pairs.agg(*[F.sum((a & b).cast("long")).alias(name) for name, a, b in (("tp", t, c), ("fp", ~t, c), ("fn", t, ~c), ("tn", ~t, ~c))])
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    cc = (tp * tn - fn * fp) / F.sqrt((tp + fn) * (tn + fp) * (tp + fp) * (tn + fn))
    ac = (tp / (tp + fn) + tp / (tp + fp) + tn / (tn + fp) + tn / (tn + fn)) / 2 - 1
    return n.select("tp", "fp", "fn", "tn", (tp / (tp + fn)).alias("sn"), (tp / (tp + fp)).alias("sp"), cc.alias("cc"), ac.alias("ac"))
