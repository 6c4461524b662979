"""Likelihoods of alignment columns on trees, by pruning over distinct columns.

Everything per column is a function of the column's tuple, so it is computed once for each distinct tuple, vectorised
over all tuples of a batch, and joined back to positions or weighted by counts. Fitting keeps the counted tuples (few,
by their nature) on the driver when their number allows it, else every evaluation is one job over the tuple table.
Log-likelihoods are natural unless named log2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import models as md
from tessera.functions.distributions import LEAST_P, chisq_cdf, half_chisq_cdf
from tessera.functions.models import TreeModel
from tessera.operators.trees import Node, copy, number
from tessera.runtime import stage

OPEN = "-*N"


def encode(tuples: Sequence[str], names: Sequence[str], leaves: Sequence[str], alphabet: str = md.DNA) -> np.ndarray:
    """(tuples x leaves) state numbers, -1 where open (gap, missing, or a leaf that the alignment lacks)."""
    table = np.full(256, -1, np.int64)
    for i, a in enumerate(alphabet):
        table[ord(a)] = i
        if a.lower() != a:
            table[ord(a.lower())] = i
    chars = np.frombuffer("".join(tuples).encode("latin-1", "replace"), np.uint8).reshape(len(tuples), -1)
    place = {n: i for i, n in enumerate(names)}
    out = np.full((len(tuples), len(leaves)), -1, np.int64)
    for j, leaf in enumerate(leaves):
        if leaf in place:
            out[:, j] = table[chars[:, place[leaf]]]
    return out


def partials(model: TreeModel, codes: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], np.ndarray]:
    """Per node: likelihoods below it (classes x tuples x states) and on the branch above it; and log scalings."""
    below: dict[int, np.ndarray] = {}
    above: dict[int, np.ndarray] = {}
    r, m, n = len(model.rates), len(codes), len(model.pi)
    scalings = np.zeros((r, m))
    eye = np.vstack([np.eye(n), np.ones(n)])  # the last row: open
    column = {leaf.id: j for j, leaf in enumerate(model.tree.leaves())}
    for node in model.tree.postorder():
        if not node.children:
            below[node.id] = np.broadcast_to(eye[codes[:, column[node.id]]][None], (r, m, n))
        else:
            x = np.prod([above[c.id] for c in node.children], axis=0)
            top = x.max(axis=2, keepdims=True)
            top[top <= 0] = 1.0
            below[node.id] = x / top
            scalings += np.log(top[:, :, 0])
        if node.parent is not None:
            above[node.id] = np.einsum("rij,rmj->rmi", model.probabilities(node), below[node.id])
    return below, above, scalings


def column_loglik(model: TreeModel, codes: np.ndarray) -> np.ndarray:
    below, _, scalings = partials(model, codes)
    per = np.log(np.maximum(below[model.tree.id] @ model.pi, 1e-300)) + scalings + np.log(model.weights)[:, None]
    top = per.max(0)
    return top + np.log(np.exp(per - top).sum(0))


def ancestral_posteriors(model: TreeModel, codes: np.ndarray) -> dict[int, np.ndarray]:
    """Per inner node: (tuples x states) probabilities given the column."""
    below, above, scalings = partials(model, codes)
    outside: dict[int, np.ndarray] = {}
    lik = np.log(np.maximum(below[model.tree.id] @ model.pi, 1e-300)) + scalings + np.log(model.weights)[:, None]
    share = np.exp(lik - lik.max(0))
    share /= share.sum(0)
    out: dict[int, np.ndarray] = {}
    for node in model.tree.preorder():
        if node.parent is None:
            outside[node.id] = np.broadcast_to(model.pi[None, None], below[node.id].shape)
        else:
            x = outside[node.parent.id]
            for sister in node.parent.children:
                if sister is not node:
                    x = x * above[sister.id]
            outside[node.id] = np.einsum("rij,rmi->rmj", model.probabilities(node), x / np.maximum(x.max(2, keepdims=True), 1e-300))
        if node.children:
            p = outside[node.id] * below[node.id]
            p = p / np.maximum(p.sum(2, keepdims=True), 1e-300)
            out[node.id] = (share[:, :, None] * p).sum(0)
    return out


# -- distributed over tuple tables -------------------------------------------------------------------------------------


def score_tuples(tuples: DataFrame, names: Sequence[str], model: TreeModel) -> DataFrame:
    """tuples with loglik, one value for each row."""
    leaves = model.tree.leaf_names()

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(column_loglik(model, encode(part.tolist(), names, leaves, model.alphabet)) if len(part) else [])

    return tuples.withColumn("loglik", run("tuple"))


def total_loglik(counts: DataFrame, names: Sequence[str], model: TreeModel) -> float:
    return float(score_tuples(counts, names, model).agg(F.sum(F.col("loglik") * F.col("cnt"))).first()[0] or 0.0)


def ancestors(tuples: DataFrame, names: Sequence[str], model: TreeModel) -> DataFrame:
    """tuple, node, base and p of every inner node and state."""
    leaves, alphabet = model.tree.leaf_names(), model.alphabet
    node_names = {n.id: n.name or str(n.id) for n in model.tree.preorder()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = ancestral_posteriors(model, encode(pdf["tuple"].tolist(), names, leaves, alphabet))
            for node, p in found.items():
                yield pd.DataFrame({"tuple": np.repeat(pdf["tuple"].to_numpy(), len(alphabet)), "node": node_names[node], "base": list(alphabet) * len(pdf), "p": p.ravel()})

    return tuples.select("tuple").distinct().mapInPandas(run, "tuple string, node string, base string, p double")


# -- optimisers --------------------------------------------------------------------------------------------------------


def gradient(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 1e-5, many: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> np.ndarray:
    """Central differences; many: values of f at several points at once."""
    h = step * np.maximum(1.0, np.abs(x))
    points = [x + sign * h[i] * (np.arange(len(x)) == i) for i in range(len(x)) for sign in (1, -1)]
    values = np.array(many(points) if many and points else [f(p) for p in points], float).reshape(-1, 2)
    return (values[:, 0] - values[:, 1]) / (2 * h)


def bfgs(f: Callable[[np.ndarray], float], x: np.ndarray, low: np.ndarray | float = -np.inf, high: np.ndarray | float = np.inf, rounds: int = 200, tolerance: float = 1e-7, many: Callable[[list[np.ndarray]], np.ndarray] | None = None, longest: float = 1.0, slope: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """Least value of f inside bounds: quasi-Newton steps, cut at the bounds and at `longest` in any number, with a backtracking search.

    slope: the gradient where it is known, else it is taken from differences.
    """
    slope = slope or (lambda x: gradient(f, x, many=many))
    x = np.clip(np.asarray(x, float), low, high)
    low, high = np.broadcast_to(low, x.shape), np.broadcast_to(high, x.shape)
    value, g, h = f(x), slope(x), np.eye(len(x))
    for _ in range(rounds):
        fixed = ((x <= low) & (g > 0)) | ((x >= high) & (g < 0))
        step = -(h @ np.where(fixed, 0.0, g))
        step[fixed] = 0.0
        if step @ g >= 0:
            h, step = np.eye(len(x)), np.where(fixed, 0.0, -g)
        step = step / max(1.0, np.abs(step).max() / longest)
        length = 1.0
        while length > 1e-12:
            new = np.clip(x + length * step, low, high)
            new_value = f(new)
            if new_value <= value + 1e-4 * (g @ (new - x)):
                break
            length /= 2
        else:
            break
        new_g = slope(new)
        s, y = new - x, new_g - g
        done = abs(value - new_value) <= tolerance * (1 + abs(value)) and np.abs(s).max() < 1e-6 * (1 + np.abs(x).max())
        x, value, g = new, new_value, new_g
        if (sy := s @ y) > 1e-12:
            rho, eye = 1 / sy, np.eye(len(x))
            h = (eye - rho * np.outer(s, y)) @ h @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        if done or np.abs(np.where(fixed, 0, g)).max() < 1e-6:
            break
    return x, value


def brent(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-8, rounds: int = 200) -> tuple[float, float]:
    """Least value of a function of one variable: the vertex of the parabola through a bracket's three points, or a golden section where that gains too little."""
    section = (3 - 5**0.5) / 2
    left, middle, right = low, low + section * (high - low), high
    at = {p: f(p) for p in (left, middle, right)}
    for _ in range(rounds):
        if right - left <= tolerance * (2 + abs(middle)):
            break
        slope_l, slope_r = (at[middle] - at[left]) / (middle - left), (at[right] - at[middle]) / (right - middle)
        bend = slope_r - slope_l
        vertex = (left + middle) / 2 - slope_l * (right - left) / (2 * bend) if bend > 0 else left
        wide_left = middle - left > right - middle
        golden = middle - section * (middle - left) if wide_left else middle + section * (right - middle)
        least = tolerance * (1 + abs(middle)) / 2
        inside = left + least < vertex < right - least
        new = vertex if inside and abs(vertex - middle) < (right - left) / 4 else golden
        if abs(new - middle) < least:  # look just beside the middle, on its longer side
            new = middle - least if wide_left else middle + least
        at[new] = f(new)
        inner, outer = sorted((new, middle))
        if at[inner] <= at[outer]:
            middle, right = inner, outer
        else:
            left, middle = inner, outer
    return middle, at[middle]


# -- fitting -----------------------------------------------------------------------------------------------------------

KINDS = ("JC69", "F81", "K80", "HKY85", "GC", "REV", "SSREV", "UNREST")


def rate_matrix(kind: str, pi: np.ndarray, free: np.ndarray) -> np.ndarray:
    if kind == "JC69":
        return md.jc69()[0]
    if kind == "F81":
        return md.f81(pi)
    if kind in ("K80", "HKY85"):
        return md.hky85(pi, free[0])
    if kind == "GC":
        return md.gc_model(pi, free[0], free[1])
    if kind == "REV":
        return md.reversible(pi, np.r_[free, 1.0])
    if kind == "SSREV":
        return md.strand_symmetric(pi, np.r_[free, 1.0])
    if kind == "UNREST":
        return md.unrestricted(pi, np.r_[free, 1.0])
    raise ValueError(f"no model is called {kind}")


def first_values(kind: str) -> np.ndarray:
    return {"JC69": np.zeros(0), "F81": np.zeros(0), "K80": np.array([4.0]), "HKY85": np.array([4.0]), "GC": np.array([4.0, 1.0]), "REV": np.array([1.0, 4.0, 1.0, 1.0, 4.0]), "SSREV": np.array([1.0, 4.0, 1.0]), "UNREST": np.where(np.isin(np.arange(11), (1, 5, 6)), 4.0, 1.0)}[kind]


def base_frequencies(tuples: Sequence[str], counts: np.ndarray, alphabet: str = md.DNA) -> np.ndarray:
    n = np.array([sum(c * t.count(a) for t, c in zip(tuples, counts)) for a in alphabet], float)
    return n / n.sum()


#: Distinct tuples that the driver holds for fitting; of more, every step of the search is a job over the table.
MOST_TUPLES = 200_000


def fit(counts: DataFrame, names: Sequence[str], tree: Node, kind: str = "REV", classes: int = 1, alpha: float = 1.0) -> tuple[TreeModel, float]:
    """Maximum-likelihood branch lengths, rates and (with several classes) gamma shape; the model and its log-likelihood."""
    from tessera.operators.estimation import fit_parts

    models, value = fit_parts(counts, names, tree, kind, classes=classes, alpha=alpha)
    return next(iter(models.values())), value


# -- site tests --------------------------------------------------------------------------------------------------------


def has_data(codes: np.ndarray) -> np.ndarray:
    return (codes >= 0).sum(1) >= 2


def _golden(at: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Where functions of one number are greatest, and their values: golden sections of all of them side by side."""
    ratio = (5**0.5 - 1) / 2
    a, b = low.astype(float), high.astype(float)
    x1, x2 = b - ratio * (b - a), a + ratio * (b - a)
    f1, f2 = at(x1), at(x2)
    for _ in range(rounds):
        left = f1 > f2
        a, b = np.where(left, a, x1), np.where(left, x2, b)
        n1, n2 = b - ratio * (b - a), a + ratio * (b - a)
        fresh = at(np.where(left, n1, n2))
        f1, f2 = np.where(left, fresh, f2), np.where(left, f1, fresh)
        x1, x2 = n1, n2
    s = (a + b) / 2
    s = np.where(s < low + 1e-6, low, s)
    return s, at(s)


def _bounds(mode: str, n: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    low, high = {"CON": (0.0, 1.0), "ACC": (1.0, most)}.get(mode, (0.0, most))
    return np.full(n, low), np.full(n, high)


def _tails(delta: np.ndarray, mode: str, faster: np.ndarray) -> np.ndarray:
    """CON and ACC against half a chi-square, the others against a chi-square of one degree; CONACC is negative where faster."""
    tail = half_chisq_cdf if mode in ("CON", "ACC") else chisq_cdf
    values, place = np.unique(np.maximum(delta, 0.0), return_inverse=True)  # most columns share a few statistics
    p = np.array([max(tail(d, 1, lower=False), LEAST_P) if d > 0 else 1.0 for d in values.tolist()])[place.ravel()]
    return np.where(faster, -p, p) if mode == "CONACC" else p


def scale_tests(model: TreeModel, codes: np.ndarray, mode: str = "CONACC", most: float = 20.0) -> pd.DataFrame:
    """Per tuple: null and best log-likelihood over a scale of all branches, the scale, twice their gap, and p.

    CON: only slower, ACC: only faster (each against half a chi-square), NNEUT and CONACC: both (chi-square of one
    degree); in CONACC p is negative where the column is faster. Columns with fewer than two bases get scale 1, p 1.
    """
    ok = has_data(codes)
    null = column_loglik(model, codes)
    scale, best = np.ones(len(codes)), null.copy()
    if ok.any():
        c = codes[ok]
        s, value = _golden(lambda x: _scaled(model, c, x), *_bounds(mode, len(c), most))
        better = value > null[ok]
        scale[ok], best[ok] = np.where(better, s, 1.0), np.where(better, value, null[ok])
    delta = np.maximum(2 * (best - null), 0.0)
    return pd.DataFrame({"null_loglik": null, "alt_loglik": best, "scale": scale, "lr": delta, "p": _tails(delta, mode, scale > 1)})


def branches_below(model: TreeModel, name: str, leading: bool = False) -> frozenset[int]:
    """The nodes whose branches lie in the subtree of a named node (a leaf, or an inner node by its name or number), with its own branch if leading."""
    top = next((n for n in model.tree.preorder() if name in (n.name, str(n.id))), None)
    if top is None:
        raise ValueError(f"the tree has no node {name}")
    found = {n.id for n in top.preorder()}
    return frozenset(found if leading or not top.children else found - {top.id})


def subtree_tests(model: TreeModel, codes: np.ndarray, branches: frozenset[int], mode: str = "CONACC", most: float = 20.0, rounds: int = 8) -> pd.DataFrame:
    """Per tuple: whether a subtree is slower or faster than the rest of the tree.

    The null has one scale for all branches, the alternative one for the subtree's and one for the rest, found by golden
    sections in turn. subtree_scale is their ratio; a ratio on the side that the mode excludes is the null. Columns with
    fewer than two bases, or none in the subtree, get scales and p of 1.
    """
    inside = np.array([leaf.id in branches for leaf in model.tree.leaves()])
    ok = has_data(codes) & ((codes >= 0) & inside[None, :]).any(1)
    base = column_loglik(model, codes)
    out = {"null_scale": np.ones(len(codes)), "null_loglik": base, "scale": np.ones(len(codes)), "subtree_scale": np.ones(len(codes)), "alt_loglik": base.copy()}
    if ok.any():
        c = codes[ok]
        for k, v in _two_scales(lambda x, y: _scaled(model, c, x, branches, y), len(c), mode, most, rounds).items():
            out[k] = np.where(ok, 0.0, out[k])
            out[k][ok] = v
    delta = np.maximum(2 * (out["alt_loglik"] - out["null_loglik"]), 0.0)
    return pd.DataFrame(out | {"lr": delta, "p": _tails(delta, mode, out["subtree_scale"] > 1)})


#: Common scales at which the information of a column is known; between them it is interpolated.
SCALES = np.geomspace(0.02, 20.0, 25)


def subtree_information(model: TreeModel, branches: frozenset[int], pattern: np.ndarray, scales: np.ndarray = SCALES, draws: int = 2000) -> np.ndarray:
    """(scales x 3): at each common scale the expected squares and product of a column's derivatives by the logarithms of
    the common scale and of the subtree's own, over columns drawn from the model with the same open rows."""
    out = np.empty((len(scales), 3))
    for i, s in enumerate(scales):
        drawn = simulate(model.with_(scale=model.scale * s), draws, np.random.default_rng(1))
        drawn[:, pattern] = -1
        whole, own = _two_derivatives(model, drawn, np.full(draws, s), branches)
        out[i] = (whole**2).mean(), (whole * own).mean(), (own**2).mean()
    return out


def _two_derivatives(model: TreeModel, codes: np.ndarray, scales: np.ndarray, branches: frozenset[int], step: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of each column's log-likelihood by the logarithms of the common scale and of the subtree's own."""
    up, down = scales * (1 + step), scales * (1 - step)
    whole = _scaled(model, codes, up, branches, up) - _scaled(model, codes, down, branches, down)
    own = _scaled(model, codes, scales, branches, up) - _scaled(model, codes, scales, branches, down)
    return whole / (2 * step), own / (2 * step)


def _information_at(model: TreeModel, codes: np.ndarray, scales: np.ndarray, branches: frozenset[int]) -> np.ndarray:
    """(columns x 3): the information at each column's common scale, by its open rows."""
    out = np.empty((len(codes), 3))
    patterns, inverse = np.unique(codes < 0, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    for i, pattern in enumerate(patterns):
        grid, at = subtree_information(model, branches, pattern), inverse == i
        for j in range(3):
            out[at, j] = np.interp(np.log(np.maximum(scales[at], SCALES[0])), np.log(SCALES), grid[:, j])
    return out


def _efficient(whole: np.ndarray, own: np.ndarray, information: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subtree's score and its variance, freed of what the common scale explains."""
    share = information[..., 1] / np.maximum(information[..., 0], 1e-12)
    return own - share * whole, np.maximum(information[..., 2] - share * information[..., 1], 1e-12)


def subtree_scores(model: TreeModel, codes: np.ndarray, branches: frozenset[int], mode: str = "CONACC", most: float = 20.0) -> pd.DataFrame:
    """Per tuple: the score test of a subtree's own scale, with the common scale at its best under the null.

    deriv is the derivative by the logarithm of the subtree's scale, less the part that the common scale explains; stat its
    square over its variance. Columns with fewer than two bases, or none in the subtree, get 0 and p 1.
    """
    inside = np.array([leaf.id in branches for leaf in model.tree.leaves()])
    ok = has_data(codes) & ((codes >= 0) & inside[None, :]).any(1)
    scale, first, stat = np.ones(len(codes)), np.zeros(len(codes)), np.zeros(len(codes))
    if ok.any():
        c = codes[ok]
        s, _ = _golden(lambda x: _scaled(model, c, x, branches, x), *_bounds("NNEUT", len(c), most))
        s = np.maximum(s, SCALES[0])
        u, variance = _efficient(*_two_derivatives(model, c, s, branches), _information_at(model, c, s, branches))
        scale[ok], first[ok], stat[ok] = s, u, u**2 / variance
    stat = np.where((first > 0 if mode == "CON" else first < 0) if mode in ("CON", "ACC") else False, 0.0, stat)
    return pd.DataFrame({"null_scale": scale, "deriv": first, "stat": stat, "p": _tails(stat, mode, first > 0)})


def _two_scales(at: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, mode: str, most: float, rounds: int) -> dict[str, np.ndarray]:
    """The best common scale of n functions of two scales, and the best two: of the rest and of the subtree."""
    low, high = _bounds("NNEUT", n, most)
    s, null = _golden(lambda x: at(x, x), low, high)
    rest, sub, value = s, s, null
    for _ in range(rounds):
        u, _ = _golden(lambda x: at(rest, x), low, high, 25)  # noqa: B023
        r, new = _golden(lambda x: at(x, u), low, high, 25)  # noqa: B023
        better = new > value
        rest, sub, value = np.where(better, r, rest), np.where(better, u, sub), np.where(better, new, value)
    good = {"CON": sub <= rest, "ACC": sub >= rest}.get(mode, np.ones(n, bool))
    rest, sub, value = np.where(good, rest, s), np.where(good, sub, s), np.where(good, value, null)
    return {"null_scale": s, "null_loglik": null, "scale": rest, "subtree_scale": np.where(sub == rest, 1.0, sub / np.maximum(rest, 1e-6)), "alt_loglik": value}


def feature_tests(codes: np.ndarray, counts: np.ndarray, model: TreeModel, method: str = "LRT", mode: str = "CONACC", most: float = 20.0, branches: frozenset[int] | None = None) -> dict[str, float]:
    """The statistics of the columns of one feature together, from its distinct tuples and their counts.

    LRT: one scale for all columns (of the subtree against the rest, with branches); SCORE: summed derivatives against
    summed information (with branches at the best common scale, freed of what that explains); GERP: the columns' neutral lengths, and what the feature's scale leaves of them.
    """
    if method == "SCORE" and branches is not None:
        low, high = _bounds("NNEUT", 1, most)
        s, _ = _golden(lambda x: np.array([float(_scaled(model, codes, np.full(len(codes), x[0]), branches, np.full(len(codes), x[0])) @ counts)]), low, high)
        s = np.full(len(codes), max(float(s[0]), SCALES[0]))
        ok = has_data(codes)
        whole, own = (float((x * counts)[ok].sum()) for x in _two_derivatives(model, codes, s, branches))
        u, variance = _efficient(np.array(whole), np.array(own), (_information_at(model, codes, s, branches) * counts[:, None])[ok].sum(0))
        stat = float(u**2 / variance)
        stat = 0.0 if mode == "CON" and u > 0 or mode == "ACC" and u < 0 else stat
        return {"null_scale": float(s[0]) if len(s) else 1.0, "deriv": float(u), "stat": stat, "p": float(_tails(np.array([stat]), mode, np.array([u > 0]))[0])}
    if method == "SCORE":
        each, info = _scores(model, codes)
        ok = has_data(codes)
        first, total = float((each * counts)[ok].sum()), float((info * counts)[ok].sum())
        stat = first**2 / total if total > 0 else 0.0
        stat = 0.0 if mode == "CON" and first > 0 or mode == "ACC" and first < 0 else stat
        return {"deriv": first, "stat": stat, "p": float(_tails(np.array([stat]), mode, np.array([first > 0]))[0])}
    total = lambda values: np.array([float(values @ counts)])
    wide = lambda x: np.full(len(codes), float(x[0]))
    one_bound = lambda m: _bounds(m, 1, most)
    if branches is None:
        null = total(column_loglik(model, codes))
        s, value = _golden(lambda x: total(_scaled(model, codes, wide(x))), *one_bound("NNEUT" if method == "GERP" else mode))
        if method == "GERP":
            neutral = float((rejected_substitutions(model, codes)["neutral"].to_numpy() * counts).sum())
            return {"neutral": neutral, "observed": neutral * float(s[0]), "rejected": neutral * (1 - float(s[0]))}
        s, value = (s, value) if value[0] > null[0] else (np.ones(1), null)
        delta = np.maximum(2 * (value - null), 0.0)
        return {"null_loglik": float(null[0]), "alt_loglik": float(value[0]), "scale": float(s[0]), "lr": float(delta[0]), "p": float(_tails(delta, mode, s > 1)[0])}
    found = {k: float(v[0]) for k, v in _two_scales(lambda x, y: total(_scaled(model, codes, wide(x), branches, wide(y))), 1, mode, most, 8).items()}
    delta = max(2 * (found["alt_loglik"] - found["null_loglik"]), 0.0)
    return found | {"lr": delta, "p": float(_tails(np.array([delta]), mode, np.array([found["subtree_scale"] > 1]))[0])}


FEATURE_COLUMNS = {"LRT": ("null_loglik", "alt_loglik", "scale", "lr", "p"), "SCORE": ("deriv", "stat", "p"), "GERP": ("neutral", "observed", "rejected"), "SUBTREE": ("null_scale", "null_loglik", "scale", "subtree_scale", "alt_loglik", "lr", "p"), "SUBTREE SCORE": ("null_scale", "deriv", "stat", "p")}


def _wanted(method: str, subtree: str | None) -> tuple[str, ...]:
    if subtree is not None and method not in ("LRT", "SCORE"):
        raise ValueError("subtrees are tested by LRT or SCORE")
    return FEATURE_COLUMNS[method if subtree is None else "SUBTREE" if method == "LRT" else "SUBTREE SCORE"]


def test_features(rows: DataFrame, names: Sequence[str], model: TreeModel, by: Sequence[str], method: str = "LRT", mode: str = "CONACC", subtree: str | None = None) -> DataFrame:
    """by, columns (their number) and the method's statistics of every feature; rows: by and col, one for each column of a feature.

    Columns are counted by feature first, so a task holds a feature's distinct tuples and never its columns.
    """
    leaves = model.tree.leaf_names()
    branches = None if subtree is None else branches_below(model, subtree)
    wanted = _wanted(method, subtree)
    counted = rows.groupBy(*by, F.col("col").alias("tuple")).agg(F.count(F.lit(1)).alias("_cnt"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema if f.name in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["_cnt"].to_numpy(float)
        found = feature_tests(encode(pdf["tuple"].tolist(), names, leaves, model.alphabet), n, model, method, mode, branches=branches)
        return pd.DataFrame([[*pdf[list(by)].iloc[0], int(n.sum()), *[found[c] for c in wanted]]], columns=[*by, "columns", *wanted])

    return counted.groupBy(*by).applyInPandas(run, f"{keys}, columns long, " + ", ".join(f"{c} double" for c in wanted))


def _scaled(model: TreeModel, codes: np.ndarray, scales: np.ndarray, branches: frozenset[int] = frozenset(), others: np.ndarray | None = None) -> np.ndarray:
    """Log-likelihood of each column at a scale of its own, and another one for some branches: eigenvalues once, probabilities for each column."""
    parts = {key: (*np.linalg.eig(q),) for key, q in [(None, model.q), *model.altered.items()]}
    parts = {key: (values, vectors, np.linalg.inv(vectors)) for key, (values, vectors) in parts.items()}
    n, r = len(model.pi), len(model.rates)
    eye = np.vstack([np.eye(n), np.ones(n)])
    column = {leaf.id: j for j, leaf in enumerate(model.tree.leaves())}
    total = np.zeros((r, len(codes)))
    for k in range(r):
        done: dict[int, np.ndarray] = {}
        for node in model.tree.postorder():
            x = eye[codes[:, column[node.id]]] if not node.children else np.prod([done[c.id] for c in node.children], axis=0)
            if node.parent is None:
                total[k] = np.log(np.maximum(x @ model.pi, 1e-300)) + np.log(model.weights[k])
            else:
                values, vectors, inverse = parts[node.id if node.id in model.altered else None]
                t = node.length * model.scale * model.rates[k] * (others if node.id in branches else scales)
                y = (x @ inverse.T) * np.exp(t[:, None] * values[None, :])
                done[node.id] = np.clip((y @ vectors.T).real, 0, None)
    top = total.max(0)
    return top + np.log(np.exp(total - top).sum(0))


def _scores(model: TreeModel, codes: np.ndarray, step: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Per tuple: the derivative of the log-likelihood by the scale at 1, and its information."""
    up, down = (_scaled(model, codes, np.full(len(codes), s)) for s in (1 + step, 1 - step))
    first = (up - down) / (2 * step)
    # the expected information of a column with these open rows, from the mean square of scores over all such columns
    info = np.empty(len(codes))
    patterns, inverse = np.unique(codes < 0, axis=0, return_inverse=True)
    rng = np.random.default_rng(1)
    for i, pattern in enumerate(patterns):
        drawn = simulate(model, 2000, rng)
        drawn[:, pattern] = -1
        u = (_scaled(model, drawn, np.full(len(drawn), 1 + step)) - _scaled(model, drawn, np.full(len(drawn), 1 - step))) / (2 * step)
        info[inverse.ravel() == i] = max((u**2).mean(), 1e-12)
    return first, info


def score_tests(model: TreeModel, codes: np.ndarray, mode: str = "CONACC") -> pd.DataFrame:
    """Per tuple: the derivative of the log-likelihood by the scale at 1, the score statistic and p."""
    first, info = _scores(model, codes)
    stat = np.where(has_data(codes), first**2 / info, 0.0)
    if mode == "CON":
        stat = np.where(first < 0, stat, 0.0)
    elif mode == "ACC":
        stat = np.where(first > 0, stat, 0.0)
    return pd.DataFrame({"deriv": first, "stat": stat, "p": _tails(stat, mode, first > 0)})


def rejected_substitutions(model: TreeModel, codes: np.ndarray) -> pd.DataFrame:
    """Per tuple: neutral length of the tree over its bases, expected substitutions and their gap; fewer than three bases give zeros."""
    from tessera.operators.trees import prune

    tests = scale_tests(model, codes, "NNEUT")
    names = model.tree.leaf_names()
    neutral = np.zeros(len(codes))
    patterns, inverse = np.unique(codes >= 0, axis=0, return_inverse=True)
    for i, pattern in enumerate(patterns):
        if pattern.sum() >= 3:
            rest, _ = prune(model.tree, [n for n, there in zip(names, pattern) if there], keep=True)
            neutral[inverse.ravel() == i] = rest.total_length()
    observed = neutral * tests["scale"].to_numpy()
    return pd.DataFrame({"neutral": neutral, "observed": observed, "rejected": neutral - observed})


def test_tuples(tuples: DataFrame, names: Sequence[str], model: TreeModel, method: str = "LRT", mode: str = "CONACC", subtree: str | None = None) -> DataFrame:
    """One row for each distinct tuple with the columns of the method: LRT or SCORE (also of a subtree) or GERP."""
    leaves, wanted = model.tree.leaf_names(), _wanted(method, subtree)
    branches = None if subtree is None else branches_below(model, subtree)
    run_one = {
        "LRT": lambda c: scale_tests(model, c, mode) if branches is None else subtree_tests(model, c, branches, mode),
        "SCORE": lambda c: score_tests(model, c, mode) if branches is None else subtree_scores(model, c, branches, mode),
        "GERP": lambda c: rejected_substitutions(model, c),
    }[method]
    columns = ", ".join(f"{c} double" for c in wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = run_one(encode(pdf["tuple"].tolist(), names, leaves, model.alphabet))
            out = out[[c.split()[0] for c in columns.split(", ")]]
            out.insert(0, "tuple", pdf["tuple"].to_numpy())
            yield out

    return tuples.select("tuple").distinct().mapInPandas(run, f"tuple string, {columns}")


def simulate(model: TreeModel, n: int, rng: np.random.Generator) -> np.ndarray:
    """n columns (x leaves) of state numbers drawn from the model."""
    k = len(model.pi)
    classes = rng.choice(len(model.rates), n, p=model.weights / model.weights.sum())
    states = {model.tree.id: rng.choice(k, n, p=model.pi / model.pi.sum())}
    for node in model.tree.preorder():
        if node.parent is not None:
            p = model.probabilities(node)[classes, states[node.parent.id]]
            p = np.cumsum(p / p.sum(1, keepdims=True), axis=1)
            states[node.id] = np.minimum((rng.random(n)[:, None] > p).sum(1), k - 1)
    return np.stack([states[leaf.id] for leaf in model.tree.leaves()], axis=1)


def with_scores(columns: DataFrame, scored: DataFrame, distinct: DataFrame, most: int = 200_000) -> DataFrame:
    """columns with the scores of their distinct ones (staged): sent to all tasks if they are few, so that a frequent column's rows are no task's alone."""
    return columns.join(F.broadcast(scored) if distinct.count() <= most else scored, "col")


def conserved_model(model: TreeModel, rho: float = 0.3) -> TreeModel:
    return model.with_(scale=model.scale * rho)


def conserved_posteriors(columns: DataFrame, names: Sequence[str], model: TreeModel, rho: float = 0.3, coverage: float = 0.3, length: float = 45.0, by: Sequence[str] = ("aln",), size: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(by, pos, posterior of the conserved state) and the elements (by, start, end, n, score: their summed log2 odds) of the best path.

    Emissions are computed once for each distinct column and joined back; the chain is run in chunks.
    """
    from tessera.operators import hmm, intervals

    chain = hmm.two_state(coverage, length)
    fast = conserved_model(model, rho)
    distinct = stage(columns.select(F.col("col").alias("tuple")).distinct(), "distinct")
    scored = score_tuples(score_tuples(distinct, names, fast).withColumnRenamed("loglik", "_c"), names, model)
    scored = scored.select(F.col("tuple").alias("col"), F.array(F.col("_c") / np.log(2.0), F.col("loglik") / np.log(2.0)).alias("emission"))
    rows = stage(with_scores(columns, scored, distinct).select(*by, "pos", "emission", (F.col("emission")[0] - F.col("emission")[1]).alias("_odds")), "emissions")
    post = hmm.posterior(rows, chain, by, size).select(*by, "pos", F.col("posterior")[0].alias("posterior"))
    path = hmm.best_path(rows, chain, by, size, ["_odds"])
    elements = intervals.runs_where(path, by, "pos", F.col("state") == 0, F.col("_odds"))
    return post, elements
