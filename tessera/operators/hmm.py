"""Hidden Markov models over long sequences, in chunks.

Rows are (by, pos, emission) with an array of log2 scores, one for each state. A sequence is cut into chunks of bounded
length. The steps of a chunk are one product of matrices (sum-product for likelihoods, max-plus for best paths), so a
first pass gives a small matrix for each chunk, many chunks at a time in numpy; the matrices of a sequence are few and
are run through in order to get what enters each chunk from both sides; a last pass finishes the chunks on their own.
No task ever holds a whole sequence, however long one key's is. All scores are log2.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import stage, unstage

CHUNK = 4096
LN2 = np.log(2.0)


@dataclass(frozen=True)
class Hmm:
    """Transition probabilities (rows add up to 1), begin and, if any, end probabilities."""

    transition: np.ndarray
    begin: np.ndarray
    end: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.begin)

    def logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            return np.log2(self.transition), np.log2(self.begin), np.zeros(self.n) if self.end is None else np.log2(self.end)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log2(np.exp2(x - safe).sum(axis=axis)) + safe.squeeze(axis)


# -- whole sequences in numpy ------------------------------------------------------------------------------------------


def forward(model: Hmm, emission: np.ndarray, enter: np.ndarray | None = None) -> np.ndarray:
    """Scores (length x states); enter: scores before the first row, else the begin probabilities are used."""
    t, b, _ = model.logs()
    out = np.empty_like(emission)
    out[0] = (b if enter is None else logsum(enter[:, None] + t, 0)) + emission[0]
    for i in range(1, len(emission)):
        out[i] = logsum(out[i - 1][:, None] + t, 0) + emission[i]
    return out


def backward(model: Hmm, emission: np.ndarray, leave: np.ndarray | None = None) -> np.ndarray:
    """leave: scores after the last row, else the end probabilities are used."""
    t, _, e = model.logs()
    out = np.empty_like(emission)
    out[-1] = e if leave is None else leave
    for i in range(len(emission) - 2, -1, -1):
        out[i] = logsum(t + (emission[i + 1] + out[i + 1])[None, :], 1)
    return out


def posteriors(f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised row by row."""
    x = f + b
    return np.exp2(x - logsum(x, 1)[:, None])


def viterbi(model: Hmm, emission: np.ndarray, enter: np.ndarray | None = None, last: int | None = None) -> tuple[np.ndarray, float]:
    """Best path and its score; among equals the first predecessor wins. last: the state to end in."""
    t, b, e = model.logs()
    back = np.zeros(emission.shape, np.int32)
    if enter is None:
        score = b + emission[0]
    else:
        x = enter[:, None] + t
        back[0] = x.argmax(0)
        score = x.max(0) + emission[0]
    for i in range(1, len(emission)):
        x = score[:, None] + t
        back[i] = x.argmax(0)
        score = x.max(0) + emission[i]
    state = int((score + e).argmax()) if last is None else last
    total = float(score[state] + (e[state] if last is None else 0.0))
    path = np.empty(len(emission), np.int32)
    for i in range(len(emission) - 1, -1, -1):
        path[i] = state
        state = back[i][state]
    return path, total


def path_score(model: Hmm, emission: np.ndarray, path: np.ndarray) -> float:
    t, b, e = model.logs()
    return float(b[path[0]] + t[path[:-1], path[1:]].sum() + emission[np.arange(len(path)), path].sum() + e[path[-1]])


def sample_path(model: Hmm, f: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A path drawn from the posterior, backwards over forward scores."""
    t, _, e = model.logs()
    path = np.empty(len(f), np.int32)
    x = f[-1] + e
    for i in range(len(f) - 1, -1, -1):
        p = np.exp2(x - x.max())
        path[i] = rng.choice(len(p), p=p / p.sum())
        if i:
            x = f[i - 1] + t[:, path[i]]
    return path


def subset_score(model: Hmm, emission: np.ndarray, states: Sequence[int]) -> float:
    """Log-likelihood of rows when only some states may be used."""
    s = list(states)
    sub = Hmm(model.transition[np.ix_(s, s)], model.begin[s], None if model.end is None else model.end[s])
    return float(logsum(forward(sub, emission[:, s])[-1] + sub.logs()[2], 0))


def log_odds(model: Hmm, emission: np.ndarray, test: Sequence[int], null: Sequence[int]) -> float:
    return subset_score(model, emission, test) - subset_score(model, emission, null)


def cross_product(a: Hmm, b: Hmm) -> Hmm:
    """States are pairs (of a, of b), b's changing fastest."""
    return Hmm(np.kron(a.transition, b.transition), np.kron(a.begin, b.begin), None if a.end is None or b.end is None else np.kron(a.end, b.end))


def autocorrelated(k: int, keep: float) -> Hmm:
    """A chain that stays with weight `keep` and else draws any of k states alike."""
    return Hmm(keep * np.eye(k) + (1 - keep) / k * np.ones((k, k)), np.full(k, 1 / k))


def two_state(coverage: float, length: float) -> Hmm:
    """State 0 in runs of expected length `length` that cover `coverage` of all rows."""
    mu = 1 / length
    nu = coverage * mu / (1 - coverage)
    return Hmm(np.array([[1 - mu, mu], [nu, 1 - nu]]), np.array([nu, mu]) / (mu + nu))


def add_bias(model: Hmm, background: Sequence[int], bias: float) -> Hmm:
    """log2 bias on the steps from background states to others, then normalised again."""
    t = model.transition.copy()
    inside = np.isin(np.arange(model.n), list(background))
    t[np.ix_(inside, ~inside)] *= 2.0**bias
    return Hmm(t / t.sum(1, keepdims=True), model.begin, model.end)


def reverse_strand(model: Hmm, pivots: Sequence[int]) -> tuple[Hmm, list[tuple[int, int]]]:
    """The model for both strands: pivot states are shared, the others doubled with their steps reversed; states are (origin, strand)."""
    pi = stationary(model.transition)
    states = [(s, 0) for s in range(model.n)] + [(s, 1) for s in range(model.n) if s not in pivots]
    flipped = (pi[:, None] * model.transition).T / pi[:, None]
    t = np.zeros((len(states), len(states)))
    for i, (a, sa) in enumerate(states):
        for j, (b, sb) in enumerate(states):
            if sa == 0 and sb == 0:
                t[i, j] = model.transition[a, b] * (0.5 if a in pivots and b not in pivots else 1)
            elif a in pivots and sb == 1:
                t[i, j] = 0.5 * flipped[a, b]
            elif sa == 1 and (sb == 1 or b in pivots):
                t[i, j] = flipped[a, b]
    begin = np.array([model.begin[a] * (1 if a in pivots else 0.5) for a, _ in states])
    return Hmm(t / t.sum(1, keepdims=True), begin / begin.sum()), states


def stationary(t: np.ndarray) -> np.ndarray:
    a = np.vstack([t.T - np.eye(len(t)), np.ones(len(t))])
    return np.linalg.lstsq(a, np.r_[np.zeros(len(t)), 1.0], rcond=None)[0]


# -- distributed -------------------------------------------------------------------------------------------------------


def _chunked(rows: DataFrame, by: Sequence[str], size: int, carry: Sequence[str] = ()) -> DataFrame:
    """by, chunk, places and scores of each chunk, and the carried columns as arrays; pos counts from 1 without holes."""
    at = F.expr(f"(pos - 1) div {size}")
    packed = rows.groupBy(*by, at.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "emission", *carry))).alias("_x"))
    return packed.select(*by, "chunk", F.col("_x.pos").alias("places"), F.flatten(F.col("_x.emission")).alias("scores"), *[F.col(f"_x.{c}").alias(c) for c in carry])


def _products(model: Hmm, size: int, best: bool, batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The matrix of every chunk: from the state before it (any, for a first chunk) to its last one; chunks go side by side."""
    t, b, _ = model.logs()
    n = model.n
    for pdf in batches:
        out = []
        lengths = pdf["places"].map(len).to_numpy()
        for length in np.unique(lengths):
            some = pdf[lengths == length]
            e = np.stack(some["scores"].to_numpy()).reshape(len(some), length, n)
            step = np.where((some["chunk"].to_numpy() == 0)[:, None, None], b[None, None, :], t[None]) + e[:, 0][:, None, :]
            m = step
            for i in range(1, length):
                x = m[:, :, :, None] + t[None, None]
                m = (x.max(2) if best else logsum(x, 2)) + e[:, i][:, None, :]
            some = some[[*by, "chunk"]].copy()
            some["matrix"] = list(m.reshape(len(some), -1))
            out.append(some)
        if out:
            yield pd.concat(out)


def _borders(model: Hmm, products: DataFrame, by: Sequence[str], best: bool) -> DataFrame:
    """by, chunk, enter (scores of the state before), leave (scores from the last row on, or the best path's last state) and total.

    A sequence's matrices are one for each chunk of thousands of rows, so a row holds them all.
    """
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in products.schema if f.name in by)
    n = model.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, _, end = model.logs()
        for pdf in batches:
            enters, leaves, totals = [], [], []
            for chain in pdf["matrices"]:
                ms = np.asarray(list(chain), float).reshape(-1, n, n)
                v = np.full(n, -np.inf)
                v[0] = 0.0
                enter = []
                for m in ms:
                    enter.append(v)
                    x = v[:, None] + m
                    v = x.max(0) if best else logsum(x, 0)
                leave = []
                if best:
                    state = int((v + end).argmax())
                    total = float((v + end)[state])
                    for m, before in zip(ms[::-1], enter[::-1]):
                        leave.append([float(state)])
                        state = int((before + m[:, state]).argmax())
                else:
                    total = float(logsum(v + end, 0))
                    w = end
                    for m in ms[::-1]:
                        leave.append(w)
                        w = logsum(m + w[None, :], 1)
                enters.append(np.concatenate(enter))
                leaves.append(np.concatenate(leave[::-1]))
                totals.append(total)
            out = pdf[list(by)].copy()
            out["enters"], out["leaves"], out["total"] = enters, leaves, totals
            yield out

    chains = products.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("chunk", "matrix"))).alias("_x")).select(*by, F.flatten(F.col("_x.matrix")).alias("matrices"))
    found = chains.mapInPandas(run, f"{keys}, enters array<double>, leaves array<double>, total double")
    wide = 1 if best else n
    each = found.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"size(enters) div {n} - 1").cast("long"))))
    return each.select(*by, "chunk", F.slice("enters", (F.col("chunk") * n + 1).cast("int"), n).alias("enter"), F.slice("leaves", (F.col("chunk") * wide + 1).cast("int"), wide).alias("leave"), "total")


def _borders_of(chunks: DataFrame, model: Hmm, by: Sequence[str], size: int, best: bool, carry: Sequence[str] = ()) -> DataFrame:
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name in by)
    products = chunks.drop(*carry).mapInPandas(lambda it: _products(model, size, best, it, by), f"{keys}, chunk long, matrix array<double>")
    return _borders(model, products, by, best)


def _pass(rows: DataFrame, model: Hmm, by: Sequence[str], size: int, best: bool, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    chunks = _chunked(rows, by, size, carry)
    return chunks, _borders_of(chunks, model, by, size, best, carry)


def log_likelihood(rows: DataFrame, model: Hmm, by: Sequence[str] = ("seq",), size: int = CHUNK) -> DataFrame:
    """by and loglik (log2) of each sequence."""
    _, borders = _pass(rows, model, by, size, best=False)
    return borders.filter("chunk = 0").select(*by, F.col("total").alias("loglik"))


def _alike(batches: Iterator[pd.DataFrame], n: int, most: int = 1 << 22) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of one length side by side, in bounded parts: their rows, emissions (chunks x length x states), which are first ones, enter and leave."""
    for pdf in batches:
        lengths = pdf["places"].map(len).to_numpy()
        for length in np.unique(lengths):
            some = pdf[lengths == length]
            step = max(1, most // (length * n * n))
            for at in range(0, len(some), step):
                part = some.iloc[at : at + step]
                wide = [np.stack(part[c].to_numpy()) for c in ("scores", "enter", "leave")]
                yield part, wide[0].reshape(len(part), length, n), part["chunk"].to_numpy() == 0, wide[1], wide[2]


def _forward_many(model: Hmm, e: np.ndarray, first: np.ndarray, enter: np.ndarray) -> np.ndarray:
    t, b, _ = model.logs()
    out = np.empty_like(e)
    out[:, 0] = np.where(first[:, None], b[None], logsum(enter[:, :, None] + t[None], 1)) + e[:, 0]
    for i in range(1, e.shape[1]):
        out[:, i] = logsum(out[:, i - 1, :, None] + t[None], 1) + e[:, i]
    return out


def _backward_many(model: Hmm, e: np.ndarray, leave: np.ndarray) -> np.ndarray:
    t, _, _ = model.logs()
    out = np.empty_like(e)
    out[:, -1] = leave
    for i in range(e.shape[1] - 2, -1, -1):
        out[:, i] = logsum(t[None] + (e[:, i + 1] + out[:, i + 1])[:, None, :], 2)
    return out


def _viterbi_many(model: Hmm, e: np.ndarray, first: np.ndarray, enter: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best paths (chunks x length) that end in the given states; among equals the first predecessor wins."""
    t, b, _ = model.logs()
    back = np.zeros(e.shape, np.int32)
    score = np.where(first[:, None], b[None], (enter[:, :, None] + t[None]).max(1)) + e[:, 0]
    for i in range(1, e.shape[1]):
        x = score[:, :, None] + t[None]
        back[:, i] = x.argmax(1)
        score = x.max(1) + e[:, i]
    path = np.empty(e.shape[:2], np.int32)
    rows, state = np.arange(len(e)), last
    for i in range(e.shape[1] - 1, -1, -1):
        path[:, i] = state
        state = back[rows, i, state]
    return path


def _finish(rows: DataFrame, model: Hmm, by: Sequence[str], size: int, best: bool, function, schema: str, carry: Sequence[str] = ()) -> DataFrame:
    """Rows of all chunks with the carried columns; function: columns (chunks x length) from what _alike gives."""
    chunks, borders = _pass(rows, model, by, size, best, carry)
    met = chunks.join(borders, [*by, "chunk"])
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, e, first, enter, leave in _alike(batches, model.n):
            flat = {c: list(v.reshape(-1, *v.shape[2:])) if v.ndim > 2 else v.ravel() for c, v in function(part, e, first, enter, leave).items()}
            kept = {c: np.concatenate(part[c].to_numpy()) for c in carry}
            yield pd.DataFrame({k: np.repeat(part[k].to_numpy(), e.shape[1]) for k in by} | {"pos": np.concatenate(part["places"].to_numpy())} | flat | kept)

    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return met.mapInPandas(run, f"{keys}, pos long, {schema}{more}")


def posterior(rows: DataFrame, model: Hmm, by: Sequence[str] = ("seq",), size: int = CHUNK) -> DataFrame:
    """by, pos and posterior (array over states) of every row."""

    def many(part, e, first, enter, leave) -> dict:
        x = _forward_many(model, e, first, enter) + _backward_many(model, e, leave)
        return {"posterior": np.exp2(x - logsum(x, 2)[:, :, None])}

    return _finish(rows, model, by, size, False, many, "posterior array<double>").select(*by, "pos", "posterior")


def best_path(rows: DataFrame, model: Hmm, by: Sequence[str] = ("seq",), size: int = CHUNK, carry: Sequence[str] = ()) -> DataFrame:
    """by, pos, state of the most probable path, its score for the sequence, and the carried columns."""

    def many(part, e, first, enter, leave) -> dict:
        path = _viterbi_many(model, e, first, enter, leave[:, 0].astype(int))
        return {"state": path, "score": np.repeat(part["total"].to_numpy()[:, None], e.shape[1], axis=1)}

    return _finish(rows, model, by, size, True, many, "state int, score double", carry).select(*by, "pos", "state", "score", *carry)


def _expected(model: Hmm, part: pd.DataFrame, e: np.ndarray, first: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Of chunks side by side: expected steps and begins, the log-likelihood of those that are first, and each row's posterior."""
    t, _, _ = model.logs()
    f, b = _forward_many(model, e, first, enter), _backward_many(model, e, leave)
    sums = part["total"].to_numpy()
    before = np.concatenate([enter[:, None, :], f[:, :-1]], axis=1)
    each = np.exp2(before[:, :, :, None] + t[None, None] + (e + b)[:, :, None, :] - sums[:, None, None, None])
    each[first, 0] = 0.0  # no step leads to a sequence's first row
    x = np.exp2(f + b - logsum(f + b, 2)[:, :, None])
    return each.sum((0, 1)), x[first, 0].sum(0), float(sums[first].sum()), x


def _counts_of(table: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    x = np.zeros(n * n + n + 1)
    for r in table.groupBy("at").agg(F.sum("value").alias("value")).collect():  # states x states + states + 1 rows
        x[r["at"]] = r["value"]
    return x[: n * n].reshape(n, n), x[n * n : -1], float(x[-1])


def expected_counts(rows: DataFrame, model: Hmm, by: Sequence[str] = ("seq",), size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected steps (states x states), expected begins and the total log-likelihood, summed in the cluster."""
    chunks, borders = _pass(rows, model, by, size, best=False)
    n = model.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(n * n + n + 1)
        for more in _alike(batches, n):
            steps, begins, total, _ = _expected(model, *more)
            sums += np.r_[steps.ravel(), begins, total]
        yield pd.DataFrame({"at": np.arange(len(sums)), "value": sums})

    return _counts_of(chunks.join(borders, [*by, "chunk"]).mapInPandas(run, "at long, value double"), n)


def expected_tables(rows: DataFrame, model: Hmm, key: str, by: Sequence[str] = ("seq",), size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, float, DataFrame]:
    """expected_counts, and a staged table of key, state and weight: how much of each key's rows the posterior gives to each state.

    One pass: tasks add up posteriors by key before anything is shuffled.
    """
    chunks = stage(_chunked(rows, by, size, [key]), "chunks")  # read twice: for the borders and for the rows
    borders = _borders_of(chunks, model, by, size, False, [key])
    n, kind = model.n, rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, *more in _alike(batches, n):
            steps, begins, total, x = _expected(model, part, *more)
            yield pd.DataFrame({"key": None, "at": np.arange(n * n + n + 1), "value": np.r_[steps.ravel(), begins, total]})
            place, keys = pd.factorize(np.concatenate(part[key].to_numpy()))
            weights = np.stack([np.bincount(place, x[:, :, i].ravel(), len(keys)) for i in range(n)])
            yield pd.DataFrame({"key": np.tile(keys, n), "at": np.repeat(np.arange(n), len(keys)), "value": weights.ravel()})

    both = stage(chunks.join(borders, [*by, "chunk"]).mapInPandas(run, f"key {kind}, at long, value double"), "expected")
    unstage(chunks)
    table = both.filter(F.col("key").isNotNull()).groupBy(F.col("key").alias(key), F.col("at").cast("int").alias("state")).agg(F.sum("value").alias("weight"))
    return *_counts_of(both.filter(F.col("key").isNull()), n), table


def packed(rows: DataFrame, key: str, by: Sequence[str] = ("seq",), size: int = CHUNK) -> DataFrame:
    """by, chunk and the key's values of each chunk in order: what stays the same while a chain and its scores change."""
    at = F.expr(f"(pos - 1) div {size}")
    chunks = rows.groupBy(*by, at.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", key))).alias("_x"))
    return chunks.select(*by, "chunk", F.col(f"_x.{key}").alias(key))


def _ragged(batches: Iterator[pd.DataFrame], key: str, n: int, most: int = 1 << 21) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Chunks of any lengths side by side, longest first, in bounded parts: their rows, numbers of scores (steps x chunks), and which steps they have."""
    for pdf in batches:
        lengths = pdf[key].map(len).to_numpy()
        order, at = np.argsort(-lengths, kind="stable"), 0
        while at < len(order):
            some = order[at : at + max(1, most // (int(lengths[order[at]]) * n * n))]
            at += len(some)
            part, alive = pdf.iloc[some], np.arange(lengths[some[0]])[None, :] < lengths[some][:, None]
            ids = np.zeros(alive.shape, np.int64)
            ids[alive] = np.concatenate(part[key].to_numpy())
            yield part, np.ascontiguousarray(ids.T), np.ascontiguousarray(alive.T)


def _ragged_products(model: Hmm, first: np.ndarray, e: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The matrices (chunks x states x states) of _products; e: states x steps x chunks; ends: how many chunks have each step."""
    t, b, _ = model.logs()
    m = np.where(first, b[None, :, None], t[:, :, None]) + e[None, :, 0]
    for i in range(1, e.shape[1]):
        k = ends[i]
        m[:, :, :k] = logsum(m[:, :, None, :k] + t[None, :, :, None], 1) + e[None, :, i, :k]
    return m.transpose(2, 0, 1)


def _ragged_passes(model: Hmm, first: np.ndarray, e: np.ndarray, ends: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward scores (states x steps x chunks); enter and leave: states x chunks."""
    t, b, _ = model.logs()
    f, w = np.zeros_like(e), np.zeros_like(e)
    f[:, 0] = np.where(first, b[:, None], logsum(enter[:, None] + t[:, :, None], 0)) + e[:, 0]
    for i in range(1, e.shape[1]):
        k = ends[i]
        f[:, i, :k] = logsum(f[:, None, i - 1, :k] + t[:, :, None], 0) + e[:, i, :k]
    w[:, -1] = leave
    for i in range(e.shape[1] - 2, -1, -1):
        k = ends[i + 1]
        w[:, i, :k] = logsum(t[:, :, None] + (e[:, i + 1, :k] + w[:, i + 1, :k])[None], 1)
        w[:, i, k:] = leave[:, k:]
    return f, w


def _packed_borders(chunks: DataFrame, model: Hmm, key: str, scores: np.ndarray, by: Sequence[str]) -> DataFrame:
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, ids, alive in _ragged(batches, key, model.n):
            m = _ragged_products(model, part["chunk"].to_numpy() == 0, scores.T[:, ids], alive.sum(1))
            yield part[[*by, "chunk"]].assign(matrix=list(m.reshape(len(part), -1)))

    return _borders(model, chunks.mapInPandas(run, f"{keys}, chunk long, matrix array<double>"), by, best=False)


def expected_packed(chunks: DataFrame, model: Hmm, key: str, scores: np.ndarray, by: Sequence[str] = ("seq",), several: bool = True) -> DataFrame:
    """What expected_tables finds, of staged packed() chunks whose key is a row of `scores` (log2, rows x states), as one table for counts_of and weights_of.

    Nothing is shuffled but sums, and what enters and leaves the chunks; not even that where no sequence has several.
    """
    n, (_, _, end) = model.n, model.logs()
    if several:
        met = chunks.join(_packed_borders(chunks, model, key, scores, by).drop("total"), [*by, "chunk"])
    else:
        met = chunks.withColumn("enter", F.array(*[F.lit(0.0)] * n)).withColumn("leave", F.array(*[F.lit(float(x)) for x in end]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, _, _ = model.logs()
        sums, weights = np.zeros(n * n + n + 1), np.zeros((n, len(scores)))
        for part, ids, alive in _ragged(batches, key, n):
            e, first, ends = scores.T[:, ids], part["chunk"].to_numpy() == 0, alive.sum(1)
            enter, leave = (np.stack(part[c].to_numpy()).T for c in ("enter", "leave"))
            f, w = _ragged_passes(model, first, e, ends, enter, leave)
            total = logsum(f[:, 0] + w[:, 0], 0)
            steps = alive.copy()
            steps[0] &= ~first  # no step leads to a sequence's first row
            before, after = np.concatenate([enter[:, None], f[:, :-1]], axis=1)[:, steps], (e + w - total)[:, steps]
            each = np.exp2(before[:, None] + t[:, :, None] + after[None]).sum(2)
            x = (f + w)[:, alive]
            x = np.exp2(x - logsum(x, 0))
            begins = np.exp2((f + w)[:, 0, first] - total[first]).sum(1)
            sums += np.r_[each.ravel(), begins, total[first].sum()]
            weights += np.stack([np.bincount(ids[alive], p, len(scores)) for p in x])
        state, row = np.nonzero(weights)
        yield pd.DataFrame({key: None, "at": np.arange(len(sums)), "value": sums})
        yield pd.DataFrame({key: row, "at": state, "value": weights[state, row]})

    return met.mapInPandas(run, f"{key} long, at long, value double").groupBy(key, "at").agg(F.sum("value").alias("value"))


def counts_of(sums: DataFrame, key: str, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected steps, expected begins and the total log-likelihood from expected_packed's table."""
    return _counts_of(sums.filter(F.col(key).isNull()), n)


def weights_of(sums: DataFrame, key: str) -> DataFrame:
    """key, state and weight from expected_packed's table."""
    return sums.filter(F.col(key).isNotNull()).select(key, F.col("at").cast("int").alias("state"), F.col("value").alias("weight"))


def reestimated(model: Hmm, steps: np.ndarray, begins: np.ndarray) -> Hmm:
    """The chain that makes expected steps and begins most likely; a state without steps keeps its own."""
    sums = steps.sum(1, keepdims=True)
    return Hmm(np.where(sums > 0, steps / np.where(sums > 0, sums, 1), model.transition), begins / begins.sum(), model.end)


def reestimated_product(a: Hmm, b: Hmm, steps: np.ndarray, begins: np.ndarray) -> tuple[Hmm, Hmm]:
    """The two chains whose cross_product makes expected steps and begins of pairs of states most likely: each one's counts are sums over the other."""
    four, pairs = steps.reshape(a.n, b.n, a.n, b.n), begins.reshape(a.n, b.n)
    return reestimated(a, four.sum((1, 3)), pairs.sum(1)), reestimated(b, four.sum((0, 2)), pairs.sum(0))


def train(rows: DataFrame, model: Hmm, by: Sequence[str] = ("seq",), rounds: int = 20, tolerance: float = 1e-3, size: int = CHUNK) -> tuple[Hmm, list[float]]:
    """Transition and begin probabilities by expectation-maximisation; the log-likelihoods of the rounds."""
    history: list[float] = []
    for _ in range(rounds):
        steps, begins, total = expected_counts(rows, model, by, size)
        history.append(total)
        if len(history) > 1 and abs(history[-1] - history[-2]) <= tolerance:
            break
        model = reestimated(model, steps, begins)
    return model, history


def train_from_paths(paths: DataFrame, states: Sequence[str], by: Sequence[str] = ("seq",), pseudo: float = 0.0) -> Hmm:
    """A model from labelled rows (by, pos, sym): counted steps and begins."""
    from tessera.operators.markov import transitions

    index = {s: i for i, s in enumerate(states)}
    t = np.full((len(states), len(states)), pseudo)
    for r in transitions(paths, by).collect():  # at most states x states rows
        t[index[r["from"]], index[r["to"]]] += r["cnt"]
    b = np.full(len(states), pseudo)
    for r in paths.filter("pos = 1").groupBy("sym").count().collect():
        b[index[r["sym"]]] += r["count"]
    sums = t.sum(1, keepdims=True)
    return Hmm(np.where(sums > 0, t / np.where(sums > 0, sums, 1), 1 / len(states)), b / b.sum())
