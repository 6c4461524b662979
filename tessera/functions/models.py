"""Substitution models: rate matrices, transition probabilities and their parameters, in numpy on the driver."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np

from tessera.functions.distributions import discrete_gamma
from tessera.functions.sequences import CODONS
from tessera.operators.trees import Node

DNA = "ACGT"
#: Pairs of bases of one chemical class.
TRANSITIONS = frozenset({"AG", "GA", "CT", "TC"})


def normalised(q: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Zero row sums and one expected substitution per unit of time."""
    q = np.array(q, float)
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(1))
    return q / -(pi * np.diag(q)).sum()


def jc69() -> tuple[np.ndarray, np.ndarray]:
    pi = np.full(4, 0.25)
    return normalised(np.ones((4, 4)), pi), pi


def f81(pi: np.ndarray) -> np.ndarray:
    return normalised(np.tile(pi, (len(pi), 1)), pi)


def hky85(pi: np.ndarray, kappa: float, alphabet: str = DNA) -> np.ndarray:
    """Rates by target frequency, transitions times kappa; other signs of the alphabet (a gap) are ordinary states."""
    q = np.tile(np.asarray(pi, float), (len(pi), 1))
    for i, a in enumerate(alphabet):
        for j, b in enumerate(alphabet):
            if a + b in TRANSITIONS:
                q[i, j] *= kappa
    return normalised(q, pi)


def k80(kappa: float) -> tuple[np.ndarray, np.ndarray]:
    pi = np.full(4, 0.25)
    return hky85(pi, kappa), pi


def gc_model(pi: np.ndarray, kappa: float, alpha: float) -> np.ndarray:
    """HKY85 with changes from A or T to G or C times alpha."""
    q = np.tile(np.asarray(pi, float), (4, 1))
    for i, a in enumerate(DNA):
        for j, b in enumerate(DNA):
            q[i, j] *= (kappa if a + b in TRANSITIONS else 1) * (alpha if a in "AT" and b in "GC" else 1)
    return normalised(q, pi)


def reversible(pi: np.ndarray, exchange: np.ndarray) -> np.ndarray:
    """exchange: upper triangle row by row of a symmetric matrix that is multiplied by the target frequencies."""
    n = len(pi)
    s = np.zeros((n, n))
    s[np.triu_indices(n, 1)] = exchange
    return normalised((s + s.T) * pi[None, :], pi)


def strand_symmetric(pi: np.ndarray, exchange: np.ndarray) -> np.ndarray:
    """Reversible with equal rates for complementary changes: AC=TG, AG=TC, AT, CG (4 parameters)."""
    ac, ag, at, cg = exchange
    pi = (pi + pi[::-1]) / 2
    return reversible(pi, np.array([ac, ag, at, cg, ag, ac]))


def unrestricted(pi: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """rates: off-diagonal entries row by row."""
    n = len(pi)
    q = np.zeros((n, n))
    q[~np.eye(n, dtype=bool)] = rates
    return normalised(q, pi)


def context_states(k: int) -> list[str]:
    return ["".join(x) for x in product(DNA, repeat=k)]


def context_reversible(pi: np.ndarray, k: int, rate: np.ndarray, symmetric: bool = False, reversible_: bool = True) -> np.ndarray:
    """Models over k neighbouring bases: only changes of one base have a rate.

    rate: one number for each free class of changes, in the order in which the classes are first met row by row. With
    `symmetric` a change and its reverse complement share a class; with `reversible_` also a change and its inverse,
    and rates are multiplied by the target's frequency.
    """
    states = context_states(k)
    q = np.zeros((len(states), len(states)))
    for (i, j), c in context_classes(k, symmetric, reversible_).items():
        q[i, j] = rate[c] * (pi[j] if reversible_ else 1.0)
    return normalised(q, pi)


def context_classes(k: int, symmetric: bool = False, reversible_: bool = True) -> dict[tuple[int, int], int]:
    states = context_states(k)
    turn = str.maketrans("ACGT", "TGCA")
    found: dict[tuple[str, str], int] = {}
    out: dict[tuple[int, int], int] = {}
    n = 0
    for i, a in enumerate(states):
        for j, b in enumerate(states):
            if sum(x != y for x, y in zip(a, b)) != 1:
                continue
            if (a, b) not in found:
                ways = {(a, b)}
                if reversible_:
                    ways.add((b, a))
                if symmetric:
                    ways |= {(x.translate(turn)[::-1], y.translate(turn)[::-1]) for x, y in ways}
                for w in ways:
                    found[w] = n
                n += 1
            out[i, j] = found[a, b]
    return out


def codon_model(pi: np.ndarray, kappa: float, omega: float, exchange: dict[str, float] | None = None) -> np.ndarray:
    """Over 64 codons: one change at a time, transitions times kappa (or `exchange` by pair of bases), changes of the amino acid times omega; stop codons only among themselves."""
    states = context_states(3)
    q = np.zeros((64, 64))
    for i, a in enumerate(states):
        for j, b in enumerate(states):
            change = [(x, y) for x, y in zip(a, b) if x != y]
            if len(change) == 1 and (CODONS[a] == "*") == (CODONS[b] == "*"):
                x, y = change[0]
                rate = exchange["".join(sorted((x, y)))] if exchange else (kappa if x + y in TRANSITIONS else 1.0)
                q[i, j] = pi[j] * rate * (1.0 if CODONS[a] == CODONS[b] else omega)
    return normalised(q, pi)


def amino_rates(q: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Rates between amino acids that a codon model induces."""
    states = context_states(3)
    names = sorted({CODONS[s] for s in states})
    member = np.array([[CODONS[s] == a for s in states] for a in names], float)
    weight = member * pi[None, :]
    out = weight @ q @ member.T / weight.sum(1, keepdims=True)
    np.fill_diagonal(out, 0)
    np.fill_diagonal(out, -out.sum(1))
    return out, names


def fixation(x: float) -> float:
    """How much likelier than a neutral change one of this strength is to spread: x / (1 - exp(-x))."""
    return 1.0 if abs(x) < 1e-9 else float(x / -np.expm1(min(-x, 700.0)))


def gain(a: str, b: str) -> int:
    """1 from A or T to G or C, -1 the other way."""
    return (b in "GC") - (a in "GC")


def _weighed(q: np.ndarray, factor: Callable[[int, int], float]) -> np.ndarray:
    out = q.copy()
    for i, j in zip(*np.nonzero(q)):
        if i != j:
            out[i, j] *= factor(int(i), int(j))
    np.fill_diagonal(out, 0)
    np.fill_diagonal(out, -out.sum(1))
    return out


def biased(q: np.ndarray, selection: float = 0.0, conversion: float = 0.0) -> np.ndarray:
    """Rates of a 4-state model under selection and GC-biased conversion, each times the fixation factor of its strength."""
    return _weighed(q, lambda i, j: fixation(selection + conversion * gain(DNA[i], DNA[j])))


def biased_codon(q: np.ndarray, selection: float = 0.0, conversion: float = 0.0) -> np.ndarray:
    """The same for 64 codons: selection acts on changes of the amino acid, conversion on the base that changes; stop codons keep their rates."""
    states = context_states(3)

    def factor(i: int, j: int) -> float:
        a, b = states[i], states[j]
        if "*" in (CODONS[a], CODONS[b]):
            return 1.0
        x, y = next((x, y) for x, y in zip(a, b) if x != y)
        return fixation(selection * (CODONS[a] != CODONS[b]) + conversion * gain(x, y))

    return _weighed(q, factor)


def is_reversible(q: np.ndarray, pi: np.ndarray, tolerance: float = 1e-6) -> bool:
    flow = pi[:, None] * q
    return bool(np.allclose(flow, flow.T, atol=tolerance))


def expm(q: np.ndarray, times: np.ndarray) -> np.ndarray:
    """e ** (q t) for several times: by eigenvalues where they are well-conditioned, else by scaling and squaring."""
    times = np.atleast_1d(np.asarray(times, float))
    try:
        values, vectors = np.linalg.eig(q)
        inverse = np.linalg.inv(vectors)
        if np.linalg.cond(vectors) < 1e8:
            out = np.einsum("ij,tj,jk->tik", vectors, np.exp(times[:, None] * values[None, :]), inverse)
            return np.clip(out.real, 0, None)
    except np.linalg.LinAlgError:
        pass
    return np.stack([expm_squaring(q * t) for t in times])


def expm_squaring(a: np.ndarray) -> np.ndarray:
    """Diagonal Pade approximant of order 8 after halving."""
    halvings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 1)
    a = a / 2.0**halvings
    top = bottom = np.eye(len(a))
    term, c = np.eye(len(a)), 1.0
    for k in range(1, 9):
        c *= (9 - k) / (k * (17 - k))
        term = term @ a
        top, bottom = top + c * term, bottom + (-1) ** k * c * term
    out = np.linalg.solve(bottom, top)
    for _ in range(halvings):
        out = out @ out
    return np.clip(out, 0, None)


@dataclass(frozen=True)
class TreeModel:
    """A tree with a rate matrix, root frequencies and rate classes (with weights)."""

    tree: Node
    q: np.ndarray
    pi: np.ndarray
    alphabet: str = DNA
    rates: np.ndarray = field(default_factory=lambda: np.ones(1))
    weights: np.ndarray = field(default_factory=lambda: np.ones(1))
    kind: str = "REV"
    alpha: float | None = None
    scale: float = 1.0
    #: The free rates behind q, where a fit found it.
    free: np.ndarray | None = None
    #: Rate matrices of single branches, by the number of the node below.
    altered: Mapping[int, np.ndarray] = field(default_factory=dict)

    def with_(self, **changes) -> TreeModel:
        return replace(self, **changes)

    @classmethod
    def gamma(cls, tree: Node, q: np.ndarray, pi: np.ndarray, alpha: float, k: int, **more) -> TreeModel:
        return cls(tree, q, pi, rates=discrete_gamma(alpha, k), weights=np.full(k, 1 / k), alpha=alpha, **more)

    def probabilities(self, node: Node) -> np.ndarray:
        """P for each rate class on the branch above a node."""
        return expm(self.altered.get(node.id, self.q), node.length * self.scale * self.rates)
