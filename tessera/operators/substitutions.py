"""Distributions of the number of substitutions on a tree, before and after seeing a column, and their p-values.

The changes on a branch are a jump process: with uniformisation, k candidate jumps keep or change the state, so the
joint law of (number of changes, end state) is a polynomial recurrence in k. Node by node these laws are multiplied up
the tree like likelihoods, with one more axis for the count (two, to part a subtree's changes from the others).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions import distributions as ds
from tessera.functions.models import TreeModel
from tessera.operators.likelihood import branches_below, encode

#: What a law may lose at its far end, as a share of all of it; supports grow until no more is lost.
LOST = 1e-14


def branch_counts(q: np.ndarray, t: float, epsilon: float = LOST) -> np.ndarray:
    """(n, i, j): probability of n changes and end state j from state i after time t, for all n that have one.

    Candidate jumps are Poisson; their number grows until its tail is below epsilon, with weights from their logarithms, so
    that long branches don't vanish.
    """
    n = len(q)
    rate = float(-np.diag(q).min()) or 1.0
    keep, change = np.eye(n) + np.diag(np.diag(q)) / rate, (q - np.diag(np.diag(q))) / rate
    mean = rate * t
    term, out, done, k = np.eye(n)[None], np.zeros((1, n, n)), 0.0, 0
    while True:
        weight = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)
        out = np.concatenate([out, np.zeros((len(term) - len(out), n, n))])
        out += weight * term
        done += weight
        if done >= 1 - epsilon or k > mean and weight < epsilon * 1e-3:
            return _trimmed(out)
        k += 1
        moved = np.zeros((len(term) + 1, n, n))
        moved[:-1] += term @ keep
        moved[1:] += term @ change
        term = _trimmed(moved)


def _trimmed(x: np.ndarray, axes: tuple[int, ...] = (0,)) -> np.ndarray:
    """Without the far ends along the count axes that hold less than LOST of every law."""
    for axis in axes:
        whole = x.sum(axes, keepdims=True)
        rest = tuple(a for a in axes if a != axis)
        tail = np.flip(np.cumsum(np.flip(x.sum(rest, keepdims=True), axis), axis), axis)
        needed = (tail > LOST * whole).any(tuple(a for a in range(x.ndim) if a != axis))
        x = np.take(x, range(max(1, int(needed.sum()))), axis)
    return x


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of independent counts along axis 0, pointwise in the others."""
    if len(a) > len(b):
        a, b = b, a
    out = np.zeros((len(a) + len(b) - 1, *np.broadcast_shapes(a.shape[1:], b.shape[1:])))
    for i in range(len(a)):
        out[i : i + len(b)] += a[i][None] * b
    return _trimmed(out)


def _multiply2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same along axes 0 and 1, by their transforms."""
    shape = (a.shape[0] + b.shape[0] - 1, a.shape[1] + b.shape[1] - 1)
    x = np.fft.irfft2(np.fft.rfft2(a, shape, axes=(0, 1)) * np.fft.rfft2(b, shape, axes=(0, 1)), shape, axes=(0, 1))
    return _trimmed(np.clip(x, 0, None), (0, 1))


def _leaf(model: TreeModel, codes: np.ndarray | None, at: int, m: int) -> np.ndarray:
    k = len(model.pi)
    return np.ones((m, k)) if codes is None else np.vstack([np.eye(k), np.ones(k)])[codes[:, at]]


def site_counts(model: TreeModel, codes: np.ndarray | None = None) -> np.ndarray:
    """(columns, n): joint probability of n changes on the tree and each column; without codes the prior law (one row)."""
    m = 1 if codes is None else len(codes)
    leaf_at = {leaf.id: j for j, leaf in enumerate(model.tree.leaves())}
    total = np.zeros((m, 1))
    for rate, weight in zip(model.rates, model.weights):
        done: dict[int, np.ndarray] = {}
        for node in model.tree.postorder():
            below = _leaf(model, codes, leaf_at[node.id], m)[None] if not node.children else np.ones((1, m, len(model.pi)))
            for c in node.children:
                below = _multiply(below, done.pop(c.id))
            if node.parent is None:
                law = weight * (below @ model.pi).T
                wide = max(total.shape[1], law.shape[1])
                total = np.pad(total, ((0, 0), (0, wide - total.shape[1]))) + np.pad(law, ((0, 0), (0, wide - law.shape[1])))
            else:
                p = branch_counts(model.altered.get(node.id, model.q), node.length * model.scale * rate)
                out = np.zeros((len(below) + len(p) - 1, m, len(model.pi)))
                for i in range(len(p)):
                    out[i : i + len(below)] += below @ p[i].T
                done[node.id] = _trimmed(out)
    return total


def site_posteriors(model: TreeModel, codes: np.ndarray) -> np.ndarray:
    x = site_counts(model, codes)
    return x / np.maximum(x.sum(1, keepdims=True), 1e-300)


def joint_counts(model: TreeModel, inside: frozenset[int] | set[int], codes: np.ndarray | None = None) -> np.ndarray:
    """(columns, changes on the branches `inside`, changes on others), joint with each column; without codes the prior law alone, as two axes."""
    m = 1 if codes is None else len(codes)
    leaf_at = {leaf.id: j for j, leaf in enumerate(model.tree.leaves())}
    total = np.zeros((1, 1, m))
    for rate, weight in zip(model.rates, model.weights):
        done: dict[int, np.ndarray] = {}
        for node in model.tree.postorder():
            below = _leaf(model, codes, leaf_at[node.id], m)[None, None] if not node.children else np.ones((1, 1, m, len(model.pi)))
            for c in node.children:
                below = _multiply2(below, done.pop(c.id))
            if node.parent is None:
                law = weight * (below @ model.pi)
                wide = np.maximum(total.shape[:2], law.shape[:2])
                total, law = (np.pad(x, ((0, wide[0] - x.shape[0]), (0, wide[1] - x.shape[1]), (0, 0))) for x in (total, law))
                total = total + law
            else:
                p = branch_counts(model.altered.get(node.id, model.q), node.length * model.scale * rate)
                own = (len(p) - 1, 0) if node.id in inside else (0, len(p) - 1)
                out = np.zeros((below.shape[0] + own[0], below.shape[1] + own[1], m, len(model.pi)))
                for i in range(len(p)):
                    a, b = (i, 0) if node.id in inside else (0, i)
                    out[a : a + below.shape[0], b : b + below.shape[1]] += below @ p[i].T
                done[node.id] = _trimmed(out, (0, 1))
    return total[:, :, 0] if codes is None else np.moveaxis(total, 2, 0)


def prior_alignment(model: TreeModel, length: int) -> np.ndarray:
    return ds.convolve(ds.normalise(site_counts(model)[0]), length)


def posterior_alignment(model: TreeModel, codes: np.ndarray, counts: Sequence[int]) -> np.ndarray:
    return ds.convolve_many(list(site_posteriors(model, codes)), counts)


def joint_prior_alignment(model: TreeModel, inside: frozenset[int] | set[int], length: int) -> np.ndarray:
    """(changes inside, changes elsewhere) of `length` columns, by doubling."""
    power, out = joint_counts(model, inside), np.ones((1, 1))
    while length:
        if length & 1:
            out = _multiply2(out, power)
        length >>= 1
        if length:
            power = _multiply2(power, power)
    return out / out.sum()


def p_values(prior: np.ndarray, mean: float) -> tuple[float, float]:
    """Chances of as few, and of as many, changes under the prior."""
    return ds.p_value(prior, math.floor(mean), "lower"), ds.p_value(prior, math.ceil(mean), "upper")


def test_sites(tuples: DataFrame, names: Sequence[str], model: TreeModel) -> DataFrame:
    """tuple, prior_mean, prior_var, post_mean, post_var, p_cons and p_acc of every distinct tuple."""
    leaves = model.tree.leaf_names()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prior = ds.normalise(site_counts(model)[0])
        pm, pv = ds.mean_var(prior)
        for pdf in batches:
            moments = [ds.mean_var(x) for x in site_posteriors(model, encode(pdf["tuple"].tolist(), names, leaves, model.alphabet))]
            ps = [p_values(prior, m) for m, _ in moments]
            yield pd.DataFrame({"tuple": pdf["tuple"].to_numpy(), "prior_mean": pm, "prior_var": pv, "post_mean": [m for m, _ in moments], "post_var": [v for _, v in moments], "p_cons": [a for a, _ in ps], "p_acc": [b for _, b in ps]})

    return tuples.select("tuple").distinct().mapInPandas(run, "tuple string, prior_mean double, prior_var double, post_mean double, post_var double, p_cons double, p_acc double")


SUBTREE_COLUMNS = ("mean_in", "mean_out", "var_in", "var_out", "p_cons_in", "p_acc_in", "p_cons_out", "p_acc_out", "total", "p_cons_given", "p_acc_given")


def _subtree_row(prior: np.ndarray, mean_in: float, mean_out: float) -> list[float]:
    """Chances of as few and of as many changes inside and outside, and inside given the expected total."""
    inside, outside = ds.marginals(prior)
    total = round(mean_in + mean_out)
    given = [1.0, 1.0]
    if total < sum(prior.shape) - 1:
        law = ds.x_given_total(prior, total)
        if law.sum() > 0:
            given = [*p_values(law, min(mean_in, float(total)))]
    return [*p_values(inside, mean_in), *p_values(outside, mean_out), float(total), *given]


def test_subtrees(tuples: DataFrame, names: Sequence[str], model: TreeModel, subtree: str) -> DataFrame:
    """Every distinct tuple's changes in a subtree and in the rest: posterior means and variances, and p-values under the joint prior law, also given the total."""
    leaves, inside = model.tree.leaf_names(), branches_below(model, subtree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prior = joint_counts(model, inside)
        prior /= prior.sum()
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                some = pdf["tuple"].iloc[at : at + 64].to_numpy()
                joint = joint_counts(model, inside, encode(some.tolist(), names, leaves, model.alphabet))
                rows = []
                for x in joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300):
                    (mi, vi), (mo, vo) = (ds.mean_var(law) for law in ds.marginals(x))
                    rows.append([mi, mo, vi, vo, *_subtree_row(prior, mi, mo)])
                yield pd.DataFrame(rows, columns=SUBTREE_COLUMNS).assign(tuple=some)[["tuple", *SUBTREE_COLUMNS]]

    return tuples.select("tuple").distinct().mapInPandas(run, "tuple string, " + ", ".join(f"{c} double" for c in SUBTREE_COLUMNS))


def test_features(columns: DataFrame, names: Sequence[str], model: TreeModel, by: Sequence[str], subtree: str | None = None) -> DataFrame:
    """by, n, post_mean, post_var, p_cons and p_acc of every feature's columns; of a subtree, n and the columns of test_subtrees.

    Moments of the posterior add up over columns, so each tuple's are computed once and summed by feature; the prior of
    a length is computed once for all features that share it.
    """
    from pyspark.sql import functions as F

    own = ("post_mean", "post_var") if subtree is None else SUBTREE_COLUMNS[:4]
    tuples = columns.select(F.col("col").alias("tuple"))
    site = (test_sites(tuples, names, model) if subtree is None else test_subtrees(tuples, names, model, subtree)).select(F.col("tuple").alias("col"), *own)
    sums = columns.join(site, "col").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in own])
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in by)
    more = ("p_cons", "p_acc") if subtree is None else SUBTREE_COLUMNS[4:]
    inside = None if subtree is None else branches_below(model, subtree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, known = ds.normalise(site_counts(model)[0]) if inside is None else None, {}
        for pdf in batches:
            rows = []
            for n, *moments in zip(pdf["n"], *[pdf[c] for c in own]):
                if n not in known:
                    if len(known) >= (4096 if inside is None else 8):
                        known.clear()
                    known[n] = ds.convolve(one, int(n)) if inside is None else joint_prior_alignment(model, inside, int(n))
                rows.append(p_values(known[n], moments[0]) if inside is None else _subtree_row(known[n], *moments[:2]))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=list(more), dtype=float)], axis=1)

    return sums.mapInPandas(run, f"{keys}, n long, " + ", ".join(f"{c} double" for c in (*own, *more)))
