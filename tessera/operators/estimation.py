"""Fitting tree models to counted tuples: one optimiser for several tables, expectation-maximisation, standard errors.

A likelihood is a sum over distinct tuples, so whatever an optimiser needs at one step (a value and a gradient: twice as many
models as parameters, plus one) is asked for as a batch: one pass over the tuple table that gives a sum for each model.
Tables of at most MOST_TUPLES distinct tuples are evaluated on the driver by the same functions; larger ones by a job.
Weights need not be whole: posterior-weighted tables of the states of a chain are fitted like counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import models as md
from tessera.functions.models import TreeModel
from tessera.operators import hmm
from tessera.operators import likelihood as lk
from tessera.operators.hmm import Hmm
from tessera.operators.trees import Node, copy, number
from tessera.runtime import release, stage, staged_paths, unstage

GROUPS = ("branches", "rates", "alpha", "scale")


# -- sums over tuple tables --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SiteClasses:
    """A mixture: each column follows one of several models, with these weights."""

    models: tuple[TreeModel, ...]
    weights: np.ndarray

    @property
    def tree(self) -> Node:
        return self.models[0].tree

    @property
    def pi(self) -> np.ndarray:
        return self.models[0].pi

    @property
    def alphabet(self) -> str:
        return self.models[0].alphabet

    def logliks(self, codes: np.ndarray) -> np.ndarray:
        """(classes x columns), with the weights."""
        return np.stack([lk.column_loglik(m, codes) + np.log(max(w, 1e-300)) for m, w in zip(self.models, self.weights)])


def loglik(model: TreeModel | SiteClasses, codes: np.ndarray) -> np.ndarray:
    if isinstance(model, TreeModel):
        return lk.column_loglik(model, codes)
    return np.logaddexp.reduce(model.logliks(codes), axis=0)


def codes_of(tuples: Sequence[str], names: Sequence[str], model: TreeModel | SiteClasses) -> np.ndarray:
    """State numbers (tuples x leaves); a model of codons or other contexts takes tuples of several columns, open where any of them is."""
    leaves, k = model.tree.leaf_names(), round(np.log(len(model.pi)) / np.log(len(model.alphabet)))
    if k == 1:
        return lk.encode(tuples, names, leaves, model.alphabet)
    wide = len(names)
    each = [lk.encode([t[i * wide : (i + 1) * wide] for t in tuples], names, leaves, model.alphabet) for i in range(k)]
    out = sum(c * len(model.alphabet) ** (k - 1 - i) for i, c in enumerate(each))
    return np.where(np.min(each, axis=0) < 0, -1, out)


class Table:
    """A table of part, tuple and cnt, and the sums that fitting asks it for."""

    def __init__(self, counts: DataFrame, names: Sequence[str], part: str | None = None):
        key = F.lit("") if part is None else F.col(part).cast("string")
        self.names = list(names)
        self.counts = counts.select(key.alias("part"), "tuple", F.col("cnt").cast("double").alias("cnt"))
        rows = self.counts.limit(lk.MOST_TUPLES + 1).collect()
        self.local = len(rows) <= lk.MOST_TUPLES
        self.rows: dict[str, tuple[list[str], np.ndarray]] = {}
        if self.local:
            for r in sorted(rows):
                self.rows.setdefault(r["part"], ([], []))
                self.rows[r["part"]][0].append(r["tuple"])
                self.rows[r["part"]][1].append(r["cnt"])
            self.rows = {k: (t, np.array(n)) for k, (t, n) in self.rows.items()}
            self.parts = sorted(self.rows)
        else:
            self.parts = [r["part"] for r in self.counts.select("part").distinct().orderBy("part").collect()]
        self._codes: dict[str, np.ndarray] = {}

    def frequencies(self, alphabet: str = md.DNA) -> dict[str, np.ndarray]:
        """The weighted frequencies of the bases in each part."""
        each = [F.sum(F.col("cnt") * (F.length("tuple") - F.length(F.translate(F.upper("tuple"), a, "")))).alias(a) for a in alphabet]
        found = {r["part"]: np.array([r[a] for a in alphabet], float) for r in self.counts.groupBy("part").agg(*each).collect()}
        return {k: n / n.sum() if n.sum() else np.full(len(alphabet), 1 / len(alphabet)) for k, n in found.items()}

    def codes(self, part: str, model: TreeModel | SiteClasses) -> np.ndarray:
        if part not in self._codes:
            self._codes[part] = codes_of(self.rows[part][0], self.names, model)
        return self._codes[part]

    def logliks(self, batch: Sequence[dict[str, TreeModel | SiteClasses]]) -> np.ndarray:
        """The log-likelihood of all parts together under each entry of the batch, which has a model for each part."""
        if self.local:
            return np.array([sum(float(n @ loglik(models[part], self.codes(part, models[part]))) for part, (_, n) in self.rows.items()) for models in batch])
        names, batch = self.names, list(batch)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(len(batch))
            for pdf in batches:
                for part, rows in pdf.groupby("part"):
                    codes, n = codes_of(rows["tuple"].tolist(), names, batch[0][part]), rows["cnt"].to_numpy()
                    sums += [float(n @ loglik(models[part], codes)) for models in batch]
            yield pd.DataFrame({"at": np.arange(len(batch)), "value": sums})

        found = self.counts.mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(len(batch))
        for r in found:
            out[r["at"]] = r["value"]
        return out

    def changes(self, models: dict[str, TreeModel]) -> tuple[dict[str, dict[int, np.ndarray]], float]:
        """For each part and branch the expected numbers of (class, state above, state below), and the log-likelihood."""
        out: dict[str, dict[int, np.ndarray]] = {p: {} for p in self.parts}
        if self.local:
            total = 0.0
            for part, (_, n) in self.rows.items():
                out[part], value = branch_changes(models[part], self.codes(part, models[part]), n)
                total += value
            return out, total
        names = self.names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part, rows in pdf.groupby("part"):
                    found, value = branch_changes(models[part], codes_of(rows["tuple"].tolist(), names, models[part]), rows["cnt"].to_numpy())
                    yield pd.DataFrame({"part": part, "node": -1, "at": [0], "value": [value]})
                    for node, x in found.items():
                        yield pd.DataFrame({"part": part, "node": node, "at": np.arange(x.size), "value": x.ravel()})

        # as many rows as the tree's branches have pairs of states
        sums = self.counts.mapInPandas(run, "part string, node int, at int, value double").groupBy("part", "node", "at").agg(F.sum("value").alias("value")).collect()
        shape = {p: (len(m.rates), len(m.pi), len(m.pi)) for p, m in models.items()}
        total = 0.0
        for r in sums:
            if r["node"] < 0:
                total += r["value"]
            else:
                out[r["part"]].setdefault(r["node"], np.zeros(np.prod(shape[r["part"]])))[r["at"]] = r["value"]
        return {p: {k: x.reshape(shape[p]) for k, x in found.items()} for p, found in out.items()}, total


def branch_changes(model: TreeModel, codes: np.ndarray, weights: np.ndarray) -> tuple[dict[int, np.ndarray], float]:
    """Per branch: weighted sums over columns of the joint probabilities (class, state above, state below) given the column."""
    below, above, scalings = lk.partials(model, codes)
    per = np.log(np.maximum(below[model.tree.id] @ model.pi, 1e-300)) + scalings + np.log(model.weights)[:, None]
    whole = np.logaddexp.reduce(per, axis=0)
    share = np.exp(per - whole) * weights
    outside = {model.tree.id: np.broadcast_to(model.pi[None, None], below[model.tree.id].shape)}
    out: dict[int, np.ndarray] = {}
    for node in model.tree.preorder():
        if node.parent is None:
            continue
        x = outside[node.parent.id]
        for sister in node.parent.children:
            if sister is not node:
                x = x * above[sister.id]
        x = x / np.maximum(x.max(2, keepdims=True), 1e-300)
        p = model.probabilities(node)
        evidence = (x * above[node.id]).sum(2)
        out[node.id] = np.einsum("rm,rmi,rij,rmj->rij", share / np.maximum(evidence, 1e-300), x, p, below[node.id], optimize=True)
        outside[node.id] = np.einsum("rij,rmi->rmj", p, x)
    return out, float(weights @ whole)


# -- parameters --------------------------------------------------------------------------------------------------------


@dataclass
class Parameters:
    """Which numbers the models of several parts have, and which of these are shared, own and free.

    shared: groups that all parts have in common; the others are each part's own. scaled: parts whose tree is multiplied by
    a scale of their own. free: the groups that an optimiser may change. All numbers are held as logarithms.
    """

    tree: Node
    kind: str
    pi: dict[str, np.ndarray]
    classes: dict[str, int]
    shared: tuple[str, ...] = ("branches", "rates", "alpha")
    scaled: tuple[str, ...] = ()
    free: tuple[str, ...] = GROUPS
    alpha: float = 1.0
    scales: dict[str, float] = field(default_factory=dict)
    rates: np.ndarray | None = None

    def __post_init__(self):
        self.tree = number(copy(self.tree))
        self.branches = [x for x in self.tree.preorder() if x.parent is not None]
        # in reversible models the root's place on its branch is free: its two sides share their length
        self.halved = self.kind != "UNREST" and len(self.tree.children) == 2
        whole = sum(c.length for c in self.tree.children)
        if self.halved:
            self.branches.remove(self.tree.children[1])
        lengths = [whole if self.halved and b is self.tree.children[0] else b.length for b in self.branches]
        first = {"branches": np.log(np.maximum(lengths, 1e-3)), "rates": np.log(lk.first_values(self.kind)) if self.rates is None else np.log(self.rates), "alpha": np.log([self.alpha])}
        self.start: dict[tuple[str, str], np.ndarray] = {}
        for part in sorted(self.pi):
            for group, values in first.items():
                if group != "alpha" or self.classes[part] > 1:
                    self.start.setdefault((group, self._slot(group, part)), values)
            if part in self.scaled:
                self.start["scale", part] = np.log([self.scales.get(part, 1.0)])

    def _slot(self, group: str, part: str) -> str:
        return "*" if group in self.shared else f"own {part}"

    def slots(self) -> list[tuple[str, str]]:
        return [k for k in self.start if k[0] in self.free]

    def vector(self) -> np.ndarray:
        return np.concatenate([self.start[k] for k in self.slots()] or [np.zeros(0)])

    def names(self) -> list[str]:
        out = []
        for group, slot in self.slots():
            each = [b.name or str(b.id) for b in self.branches] if group == "branches" else range(len(self.start[group, slot]))
            out += [f"{group}:{x}" + ("" if slot == "*" else f" of {slot.removeprefix('own ')}") for x in each]
        return out

    def values(self, x: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
        out, at = dict(self.start), 0
        for k in self.slots():
            out[k] = x[at : at + len(out[k])]
            at += len(out[k])
        return out

    def models(self, x: np.ndarray) -> dict[str, TreeModel]:
        held = self.values(x)
        out = {}
        for part, pi in self.pi.items():
            tree = copy(self.tree)
            nodes = {n.id: n for n in tree.preorder()}
            for b, v in zip(self.branches, np.exp(held["branches", self._slot("branches", part)])):
                nodes[b.id].length = float(v)
            if self.halved:
                tree.children[0].length = tree.children[1].length = tree.children[0].length / 2
            free = np.exp(held["rates", self._slot("rates", part)])
            q = lk.rate_matrix(self.kind, pi, free)
            more = {"kind": self.kind, "free": free, "scale": float(np.exp(held["scale", part][0])) if part in self.scaled else 1.0}
            if self.classes[part] > 1:
                out[part] = TreeModel.gamma(tree, q, pi, float(np.exp(held["alpha", self._slot("alpha", part)][0])), self.classes[part], **more)
            else:
                out[part] = TreeModel(tree, q, pi, **more)
        return out

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        low = np.concatenate([np.full(len(self.start[k]), -12.0) for k in self.slots()] or [np.zeros(0)])
        return low, np.full(len(low), 6.0)


def _parameters(table: Table, tree: Node, kind: str, classes: int | dict[str, int], common: bool, **more) -> Parameters:
    pi = table.frequencies()
    if common and len(pi) > 1:
        pi = dict.fromkeys(pi, np.mean(list(pi.values()), axis=0))
    if kind in ("JC69", "K80"):
        pi = dict.fromkeys(pi, np.full(4, 0.25))
    return Parameters(tree, kind, pi, classes if isinstance(classes, dict) else dict.fromkeys(pi, classes), **more)


def maximise(table: Table, parameters: Parameters, build: Callable[[np.ndarray], dict] | None = None, bounds: tuple[np.ndarray, np.ndarray] | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Where the table's log-likelihood is greatest, and its value; a gradient is one batch."""
    build = build or parameters.models
    many = lambda xs: -table.logliks([build(x) for x in xs])
    low, high = bounds or parameters.bounds()
    x, value = lk.bfgs(lambda x: float(many([x])[0]), parameters.vector() if start is None else start, low=low, high=high, many=many)
    return x, -value


def fit_parts(counts: DataFrame, names: Sequence[str], tree: Node, kind: str = "REV", part: str | None = None, classes: int | dict[str, int] = 1, common_frequencies: bool = False, **options) -> tuple[dict[str, TreeModel], float]:
    """The models of all parts of a table (part, tuple, cnt) that together make it most likely, and its log-likelihood.

    options: shared, scaled, free, alpha, scales and rates of Parameters. With nothing shared this equals fits of
    each part alone; with everything shared, one of all parts together.
    """
    table = Table(counts, names, part)
    parameters = _parameters(table, tree, kind, classes, common_frequencies, **options)
    x, value = maximise(table, parameters)
    return parameters.models(x), value


def standard_errors(counts: DataFrame, names: Sequence[str], model: TreeModel, step: float = 1e-3) -> pd.DataFrame:
    """name, value, error of each branch length, free rate and shape, from the observed information at a fitted model.

    All second differences of the log-likelihood, by the logarithms of the numbers, are one batch of models. The inverse of the
    information is the covariance; errors of the numbers are those of their logarithms times the numbers. A number that
    the table says nothing about (a branch of no length) has no error.
    """
    table = Table(counts, names)
    parameters = Parameters(model.tree, model.kind, {p: model.pi for p in table.parts}, dict.fromkeys(table.parts, len(model.rates)), alpha=model.alpha or 1.0, rates=model.free)
    x = parameters.vector()
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    moves = [np.zeros(n)]
    for i, j in pairs:
        for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1)) if i != j else ((1, 0), (-1, 0)):
            d = np.zeros(n)
            d[i] += a * step
            d[j] += b * step
            moves.append(d)
    values = table.logliks([parameters.models(x + d) for d in moves])
    information, at = np.zeros((n, n)), 1
    for i, j in pairs:
        if i == j:
            second = (values[at] - 2 * values[0] + values[at + 1]) / step**2
        else:
            second = (values[at] - values[at + 1] - values[at + 2] + values[at + 3]) / (4 * step**2)
        information[i, j] = information[j, i] = -second
        at += 2 if i == j else 4
    known = np.diag(information) > 1e-6
    errors = np.full(n, np.nan)
    covariance = np.linalg.pinv(information[np.ix_(known, known)], hermitian=True)
    errors[known] = np.sqrt(np.maximum(np.diag(covariance), 0))
    return pd.DataFrame({"name": parameters.names(), "value": np.exp(x), "error": errors * np.exp(x)})


# -- expectation-maximisation ------------------------------------------------------------------------------------------


def fit_em(counts: DataFrame, names: Sequence[str], tree: Node, kind: str = "REV", part: str | None = None, classes: int | dict[str, int] = 1, rounds: int = 500, tolerance: float = 1e-4, common_frequencies: bool = False, **options) -> tuple[dict[str, TreeModel], list[float]]:
    """As fit_parts, by expectation-maximisation: the models and the log-likelihood of every round, which never falls.

    A round is one pass over the tuples, which adds up expected changes by branch, and a search on the driver for the
    numbers that make these most likely; it ends when a round gains less than the tolerance.
    """
    table = Table(counts, names, part)
    parameters = _parameters(table, tree, kind, classes, common_frequencies, **options)
    low, high = parameters.bounds()
    x, history = parameters.vector(), []
    for _ in range(rounds):
        seen, total = table.changes(parameters.models(x))
        history.append(total)
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
        x, _ = lk.bfgs(lambda y: -expected_loglik(parameters.models(y), seen), x, low=low, high=high, rounds=30)  # noqa: B023
    return parameters.models(x), history


def expected_loglik(models: dict[str, TreeModel], seen: dict[str, dict[int, np.ndarray]]) -> float:
    """What the expected changes say of models: the log-probabilities of all of them."""
    total = 0.0
    for part, model in models.items():
        nodes = [n for n in model.tree.preorder() if n.id in seen[part]]
        times = np.concatenate([n.length * model.scale * model.rates for n in nodes])
        p = md.expm(model.q, times)
        total += float((np.concatenate([seen[part][n.id] for n in nodes]) * np.log(np.maximum(p, 1e-300))).sum())
    return total


# -- models of a chain's states ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChainFit:
    """A chain, its states' models and the log2 likelihood at the begin of every round."""

    chain: Hmm
    models: tuple[TreeModel, ...]
    history: tuple[float, ...]


def fit_chain(
    columns: DataFrame, names: Sequence[str], models: Sequence[TreeModel], chain: Hmm, learn: Sequence[str] = ("transitions", "branches", "rates"), shared: Sequence[str] = (), scaled: Sequence[int] = (),
    by: Sequence[str] = ("aln",), rounds: int | None = None, tolerance: float = 1e-2, size: int = 4096, most_scale: float | None = None,
) -> ChainFit:
    """Expectation-maximisation of a chain whose states emit columns by tree models, the models included.

    A round scores each distinct column under all states, runs the chain over the positions, and in the same pass adds up
    the posterior of each state by column: one weighted tuple table a state. The chain's steps are re-estimated from
    expected counts, the models of all states by one fit to these tables, starting at the last ones. learn: `transitions`
    and groups of numbers (branches, rates, alpha, scale); shared: groups that all states have in common; scaled: states with a
    scale of their own, at most most_scale. The likelihood never falls; it ends when a round gains less than the tolerance, or
    after `rounds` where they are given. Positions are packed into chunks once for all rounds.
    """
    models, history = list(models), []
    chunks = stage(hmm.packed(columns, "col", by, size), "chain-columns")
    distinct = stage(chunks.select(F.explode("col").alias("tuple")).distinct(), "chain-tuples")
    expected = _Numbered(chunks, distinct, names, by) if distinct.count() <= lk.MOST_TUPLES else _Joined(chunks, distinct, names, by, size)
    for k in itertools.count() if rounds is None else range(rounds):
        steps, begins, total, table = expected(chain, models)
        history.append(total)
        if k and not history[-1] - history[-2] >= tolerance:
            break
        if "transitions" in learn:
            chain = hmm.reestimated(chain, steps, begins)
        free = tuple(g for g in learn if g in GROUPS)
        if free:
            weighted = table.select(F.col("state").cast("string").alias("part"), F.col("col").alias("tuple"), F.col("weight").alias("cnt")).filter("weight > 0")
            models = _refitted(Table(weighted, names, "part"), models, tuple(shared), tuple(scaled), free, most_scale)
    expected.close()
    unstage(distinct)
    unstage(chunks)
    return ChainFit(chain, tuple(models), tuple(history))


class _Numbered:
    """A round's expected steps, begins, log-likelihood and weights of col by state, with few distinct columns: they are scored on the driver, and chunks hold their numbers."""

    def __init__(self, chunks: DataFrame, distinct: DataFrame, names: Sequence[str], by: Sequence[str]):
        self.names, self.by = list(names), list(by)
        self.tuples = sorted(r["tuple"] for r in distinct.collect())  # at most MOST_TUPLES
        self.known = stage(distinct.agg(F.sort_array(F.collect_list("tuple")).alias("_x")).select(F.posexplode("_x").alias("_id", "col")), "chain-numbers")
        self.chunks = stage(_numbers(chunks, self.tuples), "chain-chunks")
        self.several = not self.chunks.filter("chunk > 0").isEmpty()
        self.sums: DataFrame | None = None

    def __call__(self, chain: Hmm, models: Sequence[TreeModel]) -> tuple[np.ndarray, np.ndarray, float, DataFrame]:
        if self.sums is not None:
            unstage(self.sums)  # the last round's
        self.sums = stage(hmm.expected_packed(self.chunks, chain, "_id", _scores(self.tuples, self.names, models), self.by, self.several), "expected")
        return *hmm.counts_of(self.sums, "_id", chain.n), hmm.weights_of(self.sums, "_id").join(F.broadcast(self.known), "_id")

    def close(self) -> None:
        for df in (self.known, self.chunks, self.sums):
            if df is not None:
                unstage(df)


class _Joined:
    """As _Numbered, with more distinct columns: their scores are found and joined to the positions in the cluster."""

    def __init__(self, chunks: DataFrame, distinct: DataFrame, names: Sequence[str], by: Sequence[str], size: int):
        each = chunks.select(*by, "chunk", F.posexplode("col").alias("_at", "col"))
        self.columns = each.select(*by, (F.col("chunk") * size + F.col("_at") + 1).alias("pos"), "col")
        self.distinct, self.names, self.by, self.size = distinct, names, by, size
        self.left: list[str] = []

    def __call__(self, chain: Hmm, models: Sequence[TreeModel]) -> tuple[np.ndarray, np.ndarray, float, DataFrame]:
        rows, before = lk.with_scores(self.columns, _state_scores(self.distinct, self.names, models), self.distinct), set(staged_paths())
        found = hmm.expected_tables(rows, chain, "col", self.by, self.size)
        self.left = release(self.columns.sparkSession, self.left, found[-1]) + [p for p in staged_paths() if p not in before]
        return found

    def close(self) -> None:
        release(self.columns.sparkSession, self.left, self.columns)


def _numbers(chunks: DataFrame, tuples: Sequence[str]) -> DataFrame:
    """Chunks with `_id`, the places of their columns among the sorted tuples, instead of the columns."""
    keys = [c for c in chunks.columns if c != "col"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "col")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, flat = batch.column("col"), pc.list_flatten(batch.column("col"))
            ends = np.cumsum(np.r_[0, pc.list_value_length(col).to_numpy(zero_copy_only=False)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pc.index_in(flat, pa.array(tuples, flat.type)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), ids], [*keys, "_id"])

    return chunks.mapInArrow(run, f"{types}, _id array<int>")


def _scores(tuples: list[str], names: Sequence[str], models: Sequence[TreeModel]) -> np.ndarray:
    """The log2 likelihood (tuples x states) of distinct columns under every state."""
    return np.stack([loglik(m, codes_of(tuples, names, m)) for m in models], axis=1) / np.log(2.0)


def _state_scores(distinct: DataFrame, names: Sequence[str], models: Sequence[TreeModel]) -> DataFrame:
    """col and emission: the log2 likelihood of each distinct column under every state."""
    names = list(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tuples = pdf["tuple"].tolist()
            yield pd.DataFrame({"col": tuples, "emission": list(_scores(tuples, names, models))})

    return distinct.mapInPandas(run, "col string, emission array<double>")


def _refitted(table: Table, models: list[TreeModel], shared: tuple[str, ...], scaled: tuple[int, ...], free: tuple[str, ...], most_scale: float | None) -> list[TreeModel]:
    """All states' models fitted to their weighted tables, from where they are; a state that no column is in keeps its own."""
    first = models[0]
    parts = [p for p in table.parts if int(p) < len(models)]
    parameters = Parameters(first.tree, first.kind, {p: models[int(p)].pi for p in parts}, {p: len(models[int(p)].rates) for p in parts}, shared, tuple(str(s) for s in scaled), free, rates=first.free)
    for (group, slot), values in parameters.start.items():
        owner = models[int(slot.removeprefix("own "))] if slot != "*" else first
        if group == "branches":
            nodes = {n.id: n.length for n in owner.tree.preorder()}
            lengths = [sum(nodes[c.id] for c in parameters.tree.children) if parameters.halved and b is parameters.tree.children[0] else nodes[b.id] for b in parameters.branches]
            values = np.log(np.maximum(lengths, 1e-6))
        elif group == "rates" and owner.free is not None:
            values = np.log(owner.free) if len(owner.free) else np.zeros(0)
        elif group == "alpha":
            values = np.log([owner.alpha or 1.0])
        elif group == "scale":
            values = np.log([owner.scale])
        parameters.start[group, slot] = values
    low, high = parameters.bounds()
    if most_scale is not None:
        at = 0
        for k in parameters.slots():
            if k[0] == "scale":
                high[at] = np.log(most_scale)
            at += len(parameters.start[k])
    x, _ = maximise(table, parameters, bounds=(low, high))
    found = parameters.models(x)
    return [found.get(str(i), m) for i, m in enumerate(models)]


def fit_conserved(
    columns: DataFrame, names: Sequence[str], model: TreeModel, rho: float = 0.3, coverage: float = 0.3, length: float = 45.0, trees: bool = False, by: Sequence[str] = ("aln",), rounds: int | None = None, size: int = 4096, tolerance: float = 1e-2
) -> ChainFit:
    """The chain of conserved (0) and other (1) columns with its transitions and the conserved tree's scale rho (below 1); with `trees` also the tree and rates of both."""
    learn = ("transitions", "scale", *(("branches", "rates") if trees else ()))
    states = [model.with_(scale=rho), model]
    return fit_chain(columns, names, states, hmm.two_state(coverage, length), learn, ("branches", "rates", "alpha"), (0,), by, rounds, tolerance, size, 1.0)


# -- branches and sites under selection and biased conversion ----------------------------------------------------------


def alter(model: TreeModel, branches: Sequence[str], selection: float = 0.0, conversion: float = 0.0, kappa: float | None = None) -> TreeModel:
    """A model with its own rate matrix on the named branches: under selection and biased conversion, or with another kappa."""
    q = model.q if kappa is None else md.hky85(model.pi, kappa, model.alphabet)
    change = {4: md.biased, 64: md.biased_codon}[len(model.pi)]
    nodes = {n.name or str(n.id): n.id for n in model.tree.preorder()} | {str(n.id): n.id for n in model.tree.preorder()}
    missing = [b for b in branches if b not in nodes]
    if missing:
        raise ValueError(f"the tree has no branch {missing[0]}")
    return model.with_(altered=dict(model.altered) | {nodes[b]: change(q, selection, conversion) for b in branches})


def site_classes(model: TreeModel, foreground: Sequence[str], weights: Sequence[float] = (5.0, 1.0, 0.5), negative: float = -1.0, positive: float = 1.0, conversion: float = 0.0, mode: str = "none", alternative: bool = True) -> SiteClasses:
    """Classes of sites by selection on the foreground branches and on the others.

    With w0, w1 the weights: negative on all branches (w0 / (w0 + w1 + 1)), neutral on all (w1 / (w0 + w1 + 1)), and the rest
    positive in the foreground (neutral without `alternative`) over negative or neutral elsewhere, shared as w0 to w1.
    mode: `none`; `always`: conversion in the foreground in all classes; `mixed`: each class without and with it, by a third
    weight b as 1 to b.
    """
    w0, w1 = weights[:2]
    top = positive if alternative else 0.0
    change = {4: md.biased, 64: md.biased_codon}[len(model.pi)]
    share = 1 / (w0 + w1 + 1)
    four = [(w0 * share, negative, negative), (w1 * share, 0.0, 0.0), (w0 / (w0 + w1) * share, negative, top), (w1 / (w0 + w1) * share, 0.0, top)]
    strengths = {"none": [(1.0, 0.0)], "always": [(1.0, conversion)], "mixed": [(1 / (1 + weights[-1]), 0.0), (weights[-1] / (1 + weights[-1]), conversion)]}[mode]
    models, shares = [], []
    for part, bias in strengths:
        for w, behind, ahead in four:
            models.append(model.with_(q=change(model.q, behind), altered=alter(model, foreground, ahead, bias).altered))
            shares.append(w * part)
    return SiteClasses(tuple(models), np.array(shares))


def fit_site_classes(counts: DataFrame, names: Sequence[str], model: TreeModel, foreground: Sequence[str], mode: str = "none", alternative: bool = True) -> tuple[dict[str, float], float]:
    """The strengths and weights of site_classes, and a scale of the tree, that make a table most likely, and its log-likelihood.

    Twice the gap between the fits with and without `alternative` tells whether the foreground has positive selection.
    """
    names_ = ["w0", "w1", "negative", "scale", *(["positive"] if alternative else []), *(["conversion"] if mode != "none" else []), *(["b"] if mode == "mixed" else [])]

    def build(x: np.ndarray) -> dict[str, SiteClasses]:
        v = _strengths(names_, x)
        weights = (v["w0"], v["w1"], v.get("b", 1.0))
        return {"": site_classes(model.with_(scale=model.scale * v["scale"]), foreground, weights, v["negative"], v.get("positive", 0.0), v.get("conversion", 0.0), mode, alternative)}

    start = {"w0": np.log(5.0), "negative": 1.0, "positive": 1.0, "conversion": 1.0, "b": np.log(0.5)}
    least = {"negative": 0.0, "positive": 0.0, "conversion": 0.0}
    x, value = maximise(Table(counts, names), None, build, (np.array([least.get(n, -6.0) for n in names_]), np.array([40.0 if n in least else 6.0 for n in names_])), np.array([start.get(n, 0.0) for n in names_]))
    return _strengths(names_, x), value


def _strengths(names: Sequence[str], x: np.ndarray) -> dict[str, float]:
    return {n: -float(v) if n == "negative" else float(v) if n in ("positive", "conversion") else float(np.exp(v)) for n, v in zip(names, x)}


def class_posteriors(tuples: DataFrame, names: Sequence[str], model: SiteClasses) -> DataFrame:
    """tuple and posterior (array over the classes) of every distinct tuple."""
    names = list(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = model.logliks(codes_of(pdf["tuple"].tolist(), names, model))
            yield pd.DataFrame({"tuple": pdf["tuple"].to_numpy(), "posterior": list(np.exp(each - np.logaddexp.reduce(each, axis=0)).T)})

    return tuples.select("tuple").distinct().mapInPandas(run, "tuple string, posterior array<double>")


# -- chains with tied transitions --------------------------------------------------------------------------------------


def fit_biased_chain(
    columns: DataFrame, names: Sequence[str], models: Sequence[TreeModel], outer: Hmm, inner: Hmm, by: Sequence[str] = ("aln",), rounds: int = 20, tolerance: float = 1e-2, size: int = 4096
) -> tuple[Hmm, Hmm, list[float]]:
    """Two chains that run side by side (biased conversion or not, and conserved or not), re-estimated from what their pairs of states emit.

    models: one for each pair of states, the inner chain's changing fastest. The chains keep to themselves, so each has as
    few free numbers as if it ran alone.
    """
    distinct = stage(columns.select(F.col("col").alias("tuple")).distinct(), "chain-tuples")
    rows = stage(columns.select(*by, "pos", "col").join(_state_scores(distinct, names, models), "col").select(*by, "pos", "emission"), "chain-emissions")
    history: list[float] = []
    for k in range(rounds):
        steps, begins, total = hmm.expected_counts(rows, hmm.cross_product(outer, inner), by, size)
        history.append(total)
        if k and history[-1] - history[-2] < tolerance:
            break
        outer, inner = hmm.reestimated_product(outer, inner, steps, begins)
    unstage(rows)
    return outer, inner, history


@dataclass(frozen=True)
class LineageFit:
    """Ends (mu) and begins (nu) of elements, the share phi of lineage-specific ones, the states' names, and the rounds' log2 likelihoods."""

    mu: float
    nu: float
    phi: float
    states: tuple[str, ...]
    history: tuple[float, ...]


def lineage_states(model: TreeModel, rho: float) -> dict[str, tuple[TreeModel, frozenset[str] | None]]:
    """The model of each state of a lineage chain, and for those of one lineage the leaves below its branch.

    Conserved branches have their rates times rho: all of them, those from a birth's branch on, or all but those from a death's branch on.
    """
    slow = lambda ids: model.with_(altered=dict(model.altered) | {i: model.altered.get(i, model.q) * rho for i in ids})
    branches = [n for n in model.tree.preorder() if n.parent is not None]
    every = {n.id for n in branches}
    out: dict[str, tuple[TreeModel, frozenset[str] | None]] = {"neutral": (model, None), "conserved": (slow(every), None)}
    for kind in ("birth", "death"):
        for b in branches:
            below = {n.id for n in b.preorder()}
            leaves = frozenset(n.name for n in b.leaves()) if b.children else frozenset([b.name])
            out[f"{kind}:{b.name or b.id}"] = slow(below if kind == "birth" else every - below), leaves
    return out


def lineage_scores(distinct: DataFrame, names: Sequence[str], model: TreeModel, rho: float) -> DataFrame:
    """col and emission (log2) under every state. A lineage's states are closed to columns that are open in all its leaves, or in all others: these can't tell."""
    names, states = list(names), lineage_states(model, rho)
    leaves = model.tree.leaf_names()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tuples = pdf["tuple"].tolist()
            codes = lk.encode(tuples, names, leaves, model.alphabet)
            scores = []
            for m, below in states.values():
                x = lk.column_loglik(m, codes) / np.log(2.0)
                if below is not None:
                    inside = np.array([leaf in below for leaf in leaves])
                    x = np.where((codes[:, inside] >= 0).any(1) & (codes[:, ~inside] >= 0).any(1), x, -1e4)
                scores.append(x)
            yield pd.DataFrame({"col": tuples, "emission": list(np.stack(scores, axis=1))})

    return distinct.mapInPandas(run, "col string, emission array<double>")


def lineage_chain(states: Sequence[str], mu: float, nu: float, phi: float) -> Hmm:
    """Elements start with nu and end with mu; a share phi of them is lineage-specific, all lineages alike."""
    k = len(states) - 2
    start = np.r_[1 - phi, np.full(k, phi / max(k, 1))]
    t = np.zeros((k + 2, k + 2))
    t[0, 0], t[0, 1:] = 1 - nu, nu * start
    t[np.arange(1, k + 2), np.arange(1, k + 2)], t[1:, 0] = 1 - mu, mu
    return Hmm(t, np.r_[mu, nu * start] / (mu + nu))


def fit_lineages(
    columns: DataFrame, names: Sequence[str], model: TreeModel, rho: float = 0.3, mu: float = 0.05, nu: float = 0.01, phi: float = 0.5, by: Sequence[str] = ("aln",), rounds: int = 20, tolerance: float = 1e-2, size: int = 1024
) -> LineageFit:
    """mu, nu and phi of a lineage chain by expectation-maximisation: all states share them, so each is one ratio of expected steps."""
    states = tuple(lineage_states(model, rho))
    distinct = stage(columns.select(F.col("col").alias("tuple")).distinct(), "lineage-tuples")
    rows = stage(columns.select(*by, "pos", "col").join(lineage_scores(distinct, names, model, rho), "col").select(*by, "pos", "emission"), "lineage-emissions")
    history: list[float] = []
    for k in range(rounds):
        steps, begins, total = hmm.expected_counts(rows, lineage_chain(states, mu, nu, phi), by, size)
        history.append(total)
        if k and history[-1] - history[-2] < tolerance:
            break
        starts = steps[0, 1:].sum()
        nu = float(np.clip(starts / max(steps[0].sum(), 1e-300), 1e-9, 1 - 1e-9))
        mu = float(np.clip(steps[1:, 0].sum() / max(steps[1:].sum(), 1e-300), 1e-9, 1 - 1e-9))
        phi = float(np.clip(steps[0, 2:].sum() / max(starts, 1e-300), 1e-9, 1 - 1e-9))
    unstage(rows)
    return LineageFit(mu, nu, phi, states, tuple(history))


def lineage_elements(columns: DataFrame, names: Sequence[str], model: TreeModel, rho: float, fit: LineageFit, by: Sequence[str] = ("aln",), size: int = 1024) -> DataFrame:
    """by, start, end, n, state: runs of the best path that are conserved, in all lineages or in one."""
    from tessera.operators.intervals import run_lengths

    distinct = columns.select(F.col("col").alias("tuple")).distinct()
    rows = columns.select(*by, "pos", "col").join(lineage_scores(distinct, names, model, rho), "col").select(*by, "pos", "emission")
    path = hmm.best_path(rows, lineage_chain(fit.states, fit.mu, fit.nu, fit.phi), by, size)
    label = F.element_at(F.array(*map(F.lit, fit.states)), F.col("state") + 1)
    return run_lengths(path.withColumn("label", label), by, "pos", "label").filter("label <> 'neutral'").withColumnRenamed("label", "state")
