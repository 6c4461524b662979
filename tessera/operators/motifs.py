"""Motif discovery and probability codes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import distributions as ds

DNA = "ACGT"


def background(seqs: DataFrame, text: str = "text", alphabet: str = DNA) -> np.ndarray:
    """Frequencies of the alphabet's letters in all sequences."""
    n = seqs.agg(*[F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit(a), F.lit("")))).alias(a) for a in alphabet]).first()
    x = np.array([n[a] or 0 for a in alphabet], float)
    return x / x.sum()


def common_ntuples(seqs: DataFrame, k: int, n: int, text: str = "text") -> list[str]:
    """The n most frequent k-letter words, ties by name."""
    from tessera.operators.markov import gram_counts

    return [r["gram"].upper() for r in gram_counts(seqs, k, text, "[acgt]").orderBy(F.col("cnt").desc(), "gram").limit(n).collect()]


def sample_ntuples(seqs: DataFrame, k: int, n: int, seed: int, text: str = "text") -> list[str]:
    """n words drawn by the least hashes of their places; a place carries its sequence's hash, and only drawn sequences are read again."""
    each = seqs.filter(F.length(text) >= k).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    places = each.select("h", F.explode(F.sequence(F.lit(1), F.length("t") - (k - 1))).alias("i"))
    drawn = places.orderBy(F.xxhash64(F.lit(seed), "h", "i"), "h", "i").limit(n).collect()
    some = seqs.sparkSession.createDataFrame(sorted({(r["h"],) for r in drawn}), "h long")
    found = each.join(F.broadcast(some), "h", "left_semi").dropDuplicates(["h"])  # n sequences at most
    at = seqs.sparkSession.createDataFrame([(j, r["h"], r["i"]) for j, r in enumerate(drawn)], "j long, h long, i int")
    words = found.join(F.broadcast(at), "h").select("j", F.substr("t", "i", F.lit(k)).alias("w")).collect()
    return [r["w"] for r in sorted(words, key=lambda r: r["j"])]


def from_consensus(word: str, weight: float = 0.7, alphabet: str = DNA) -> np.ndarray:
    """(width, letters): the consensus letter with `weight`, the others alike; unknown letters are even."""
    rest = (1 - weight) / (len(alphabet) - 1)
    return np.array([[weight if a == c else rest for a in alphabet] if c in alphabet else [1 / len(alphabet)] * len(alphabet) for c in word.upper()])


def _encoded(text: str, alphabet: str = DNA) -> np.ndarray:
    return np.array([alphabet.find(c) for c in text.upper()], np.int64)


def start_scores(pwm: np.ndarray, bg: np.ndarray, text: str) -> np.ndarray:
    """log2 odds of the motif at every start; windows with unknown letters get minus infinity."""
    x = _encoded(text)
    w = len(pwm)
    if len(x) < w:
        return np.zeros(0)
    with np.errstate(divide="ignore"):
        odds = np.hstack([np.log2(pwm) - np.log2(bg)[None, :], np.full((w, 1), -np.inf)])
    windows = np.lib.stride_tricks.sliding_window_view(x, w)
    return odds[np.arange(w)[None, :], windows].sum(1)


def em(seqs: DataFrame, pwm: np.ndarray, bg: np.ndarray, rounds: int = 20, tolerance: float = 1e-4, pseudo: float = 0.1, text: str = "text") -> tuple[np.ndarray, list[float]]:
    """The motif with one occurrence per sequence: expected letter counts are summed in the cluster each round."""
    history: list[float] = []
    for _ in range(rounds):
        current = pwm

        def run(batches: Iterator[pd.DataFrame], current: np.ndarray = current) -> Iterator[pd.DataFrame]:
            sums, total = np.zeros(current.shape), 0.0
            for pdf in batches:
                for t in pdf[text]:
                    s = start_scores(current, bg, t or "")
                    if not np.isfinite(s).any():
                        continue
                    top = s[np.isfinite(s)].max()
                    p = np.exp2(s - top)
                    total += float(top + np.log2(p.sum() / len(s)))
                    p /= p.sum()
                    windows = np.lib.stride_tricks.sliding_window_view(_encoded(t), len(current))
                    for j in range(len(current)):
                        good = windows[:, j] >= 0
                        sums[j] += np.bincount(windows[good, j], p[good], current.shape[1])
            yield pd.DataFrame({"at": np.arange(sums.size + 1), "value": np.r_[sums.ravel(), total]})

        rows = seqs.select(text).mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        x = np.zeros(pwm.size + 1)
        for r in rows:
            x[r["at"]] = r["value"]
        history.append(float(x[-1]))
        counts = x[:-1].reshape(pwm.shape) + pseudo
        pwm = counts / counts.sum(1, keepdims=True)
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance:
            break
    return pwm, history


def predict(seqs: DataFrame, pwm: np.ndarray, bg: np.ndarray, text: str = "text") -> DataFrame:
    """Each sequence with the 1-based start and score of its best occurrence (null where none fits)."""
    names = list(seqs.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seqs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [start_scores(pwm, bg, t or "") for t in pdf[text]]
            out = pdf[names].copy()
            out["start"] = pd.array([int(s.argmax()) + 1 if len(s) and np.isfinite(s).any() else None for s in found], "Int64")
            out["score"] = [float(s.max()) if len(s) and np.isfinite(s).any() else None for s in found]
            yield out[[*names, "start", "score"]]

    return seqs.mapInPandas(run, f"{fields}, start long, score double")


def find(seqs: DataFrame, width: int, n: int = 3, text: str = "text") -> list[tuple[np.ndarray, float]]:
    """The n best motifs, each masked in the sequences before the next is sought; starts are the commonest words."""
    out, rest = [], seqs.select(text)
    for _ in range(n):
        bg = background(rest, text)
        starts = common_ntuples(rest, width, 3, text)
        if not starts:
            break
        pwm, history = max((em(rest, from_consensus(w), bg, 8, text=text) for w in starts), key=lambda r: r[1][-1])
        out.append((pwm, history[-1]))
        hit = predict(rest, pwm, bg, text)
        masked = F.when(F.col("start").isNotNull(), F.concat(F.substr(text, F.lit(1), (F.col("start") - 1).cast("int")), F.lit("N" * width), F.substr(text, (F.col("start") + width).cast("int")))).otherwise(F.col(text))
        rest = hit.select(masked.alias(text))
    return out


# -- codes -------------------------------------------------------------------------------------------------------------


def symmetric_kl(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of p against rows of q."""
    p, q = np.clip(p, 1e-12, 1)[:, None], np.clip(q, 1e-12, 1)[None]
    return ((p - q) * np.log2(p / q)).sum(2)


def nearest_codes(points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = symmetric_kl(points, codes)
    best = d.argmin(1)
    return best, d[np.arange(len(points)), best]


def k_means(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 50, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False, p=weights / weights.sum())]
    for _ in range(rounds):
        at = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([np.average(points[at == j], axis=0, weights=weights[at == j]) if (at == j).any() else centres[j] for j in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def train_codes(vectors: DataFrame, column: str, n_codes: int, parts: int = 10) -> np.ndarray:
    """A code book: vectors are binned in a grid over the simplex (which bounds what comes to the driver), then grouped by k-means over the bins' means."""
    binned = vectors.select(F.transform(column, lambda x: F.round(x * parts).cast("int")).alias("b"), F.col(column).alias("v"))
    dim = vectors.select(F.size(column).alias("n")).first()["n"]
    cells = binned.groupBy("b").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)]).collect()
    points = np.array([[r[f"m{i}"] for i in range(dim)] for r in cells])
    return k_means(points, np.array([r["n"] for r in cells], float), n_codes)


def encode(vectors: DataFrame, column: str, codes: np.ndarray) -> DataFrame:
    """vectors with code and error (symmetric Kullback-Leibler divergence)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best, error = nearest_codes(np.stack([np.asarray(v, float) for v in pdf[column]]), codes) if len(pdf) else (np.zeros(0, int), np.zeros(0))
            yield pdf.assign(code=best.astype(np.int32), error=error)

    return vectors.mapInPandas(run, f"{fields}, code int, error double")


def decode(indices: DataFrame, codes: np.ndarray, column: str = "code") -> DataFrame:
    book = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in codes])
    return indices.withColumn("vector", F.element_at(book, F.col(column) + 1))


def code_scores(codes: np.ndarray, q: np.ndarray, pi: np.ndarray, t: float) -> np.ndarray:
    """log2 odds of two codes standing at the ends of a branch of length t."""
    from tessera.functions.models import expm

    joint = pi[:, None] * expm(q, t)[0]
    return np.log2((codes / pi) @ joint @ (codes / pi).T)


def simplex_cells(dim: int, parts: int) -> np.ndarray:
    return ds.simplex_grid(dim, parts)


# -- motifs that tell two sets of sequences apart ----------------------------------------------------------------------

_PLACES = np.full(256, -1, np.int64)
for _i, _a in enumerate(DNA):
    _PLACES[[ord(_a), ord(_a.lower())]] = _i


def _odds(theta: np.ndarray, bg: np.ndarray, codes: np.ndarray) -> tuple[float, np.ndarray]:
    """The log of the mean odds of the motif over all starts of a sequence, and its slope by theta (the letters' scores, of which the matrix is the softmax)."""
    w, n = len(theta), len(codes) - len(theta) + 1
    if n < 1:
        return 0.0, np.zeros_like(theta)
    log_p = theta - np.logaddexp.reduce(theta, axis=1)[:, None]
    table = np.hstack([log_p - np.log(bg), np.full((w, 1), -np.inf)])  # the last column: a letter that the alphabet lacks
    scores = np.zeros(n)
    for k in range(w):
        scores += table[k, codes[k : k + n]]
    top = scores.max()
    if top == -np.inf:
        return 0.0, np.zeros_like(theta)
    share = np.exp(scores - top)
    total = share.sum()
    seen = np.stack([np.bincount(codes[k : k + n] % (len(bg) + 1), share, len(bg) + 1)[: len(bg)] for k in range(w)]) / total
    return float(top + np.log(total / n)), seen - np.exp(log_p)


def conditional(seqs: DataFrame, theta: np.ndarray, bias: float, bg: np.ndarray, text: str = "text", label: str = "label") -> tuple[float, np.ndarray]:
    """The log-probability of the labels (true: has the motif) given the sequences, and its gradient by theta and the bias, summed in the cluster.

    A sequence has the motif with the odds exp(bias) times its mean odds over all starts; one without a start of known
    letters says nothing but the bias. Null labels and null texts have no part.
    """
    rows = seqs.select(F.col(text).alias("text"), F.col(label).cast("boolean").alias("label")).filter("text is not null and label is not null")
    size = theta.size + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size)
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["label"]):
                value, slope = _odds(theta, bg, _PLACES[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)])
                x = value + bias
                sums[0] -= np.logaddexp(0.0, -x if y else x)
                miss = float(y) - 1 / (1 + np.exp(-np.clip(x, -700, 700)))
                sums[1:-1] += miss * slope.ravel()
                sums[-1] += miss
        yield pd.DataFrame({"at": np.arange(size), "value": sums})

    out = np.zeros(size)
    for r in rows.mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # as many rows as numbers
        out[r["at"]] = r["value"]
    return float(out[0]), out[1:]


def fit_conditional(seqs: DataFrame, start: np.ndarray, text: str = "text", label: str = "label", rounds: int = 60) -> tuple[np.ndarray, float, float]:
    """The matrix (width, letters) and bias that tell labelled sequences apart best, and the labels' log-probability: a quasi-Newton search with the exact gradient."""
    from tessera.operators.likelihood import bfgs

    bg = np.maximum(background(seqs.select(F.upper(F.col(text)).alias("text"))), 1e-6)
    shape, known = start.shape, {}

    def both(x: np.ndarray) -> tuple[float, np.ndarray]:
        key = x.tobytes()
        if key not in known:
            known.clear()
            known[key] = conditional(seqs, x[:-1].reshape(shape), float(x[-1]), bg, text, label)
        return known[key]

    x0 = np.r_[np.log(np.maximum(start, 1e-3)).ravel(), 0.0]
    x, value = bfgs(lambda x: -both(x)[0], x0, -12.0, 12.0, rounds, slope=lambda x: -both(x)[1])
    theta = x[:-1].reshape(shape)
    return np.exp(theta - np.logaddexp.reduce(theta, axis=1)[:, None]), float(x[-1]), -value
