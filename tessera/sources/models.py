"""Small model files: tree models, hidden Markov models, category maps, matrices and weight matrices.

These hold a few numbers each, so they are parsed from text on the driver; text_of() reads a file of any store through
Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.models import TreeModel
from tessera.operators.hmm import Hmm
from tessera.operators.trees import newick, parse


def text_of(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


# -- tree models -------------------------------------------------------------------------------------------------------


def parse_tree_model(text: str) -> TreeModel:
    """KEY: value lines, with the rate matrix in the lines after its key."""
    keys = dict(re.findall(r"^([A-Z_]+):[ \t]*(.*)$", text, re.M))
    alphabet = keys.get("ALPHABET", "A C G T").replace(" ", "")
    pi = np.array(keys["BACKGROUND"].split(), float)
    n = len(pi)
    numbers = re.search(r"^RATE_MAT:\s*((?:[-+0-9.eE]+\s+)+)", text, re.M)
    q = np.array(numbers.group(1).split(), float)[: n * n].reshape(n, n)
    more = {"kind": keys.get("SUBST_MOD", "REV").strip(), "alphabet": alphabet}
    tree = parse(keys["TREE"])
    if int(keys.get("NRATECATS", 1)) > 1:
        if "RATE_CONSTS" in keys:
            weights = np.array(keys["RATE_WEIGHTS"].split(), float)
            return TreeModel(tree, q, pi, rates=np.array(keys["RATE_CONSTS"].split(), float), weights=weights / weights.sum(), **more)
        return TreeModel.gamma(tree, q, pi, float(keys["ALPHA"]), int(keys["NRATECATS"]), **more)
    return TreeModel(tree, q, pi, **more)


def tree_model_text(model: TreeModel, loglik: float | None = None) -> str:
    rows = "\n".join("  " + " ".join(f"{x:11.6f}" for x in row) for row in model.q)
    gamma = f"NRATECATS: {len(model.rates)}\nALPHA: {model.alpha:.6f}\n" if model.alpha is not None else ""
    lnl = f"TRAINING_LNL: {loglik:.6f}\n" if loglik is not None else ""
    return f"ALPHABET: {' '.join(model.alphabet)}\nORDER: 0\nSUBST_MOD: {model.kind}\n{gamma}{lnl}BACKGROUND: {' '.join(f'{x:.6f}' for x in model.pi)}\nRATE_MAT:\n{rows}\nTREE: {newick(model.tree)}\n"


# -- hidden Markov models ----------------------------------------------------------------------------------------------


def _blocks(text: str) -> dict[str, list[list[float]]]:
    out: dict[str, list[list[float]]] = {}
    name = ""
    for line in text.split("\n"):
        line = line.split("#")[0].strip()
        if m := re.match(r"^([A-Z_]+)\s*:?\s*(.*)$", line):
            name = m[1]
            out[name] = []
            line = m[2]
        if line and name and re.match(r"^[-+.0-9]", line):  # a line of state names may stand above the numbers
            out[name].append([float(x) for x in line.split()])
    return out


def parse_hmm(text: str) -> Hmm:
    """Blocks of transitions, equilibrium frequencies and begin and end transitions."""
    b = _blocks(text)
    t = np.array(b["TRANSITION_MATRIX"])
    flat = lambda key: np.array([x for row in b[key] for x in row]) if b.get(key) else None
    begin = flat("BEGIN_TRANSITIONS")
    if begin is None:
        begin = flat("EQUILIBRIUM_FREQUENCIES")
    if begin is None:
        from tessera.operators.hmm import stationary

        begin = stationary(t)
    return Hmm(t, begin, flat("END_TRANSITIONS"))


def hmm_text(model: Hmm) -> str:
    rows = "\n".join(" ".join(f"{x:.6f}" for x in row) for row in model.transition)
    end = f"\nEND_TRANSITIONS\n{' '.join(f'{x:.6f}' for x in model.end)}" if model.end is not None else ""
    return f"TRANSITION_MATRIX\n{rows}\nBEGIN_TRANSITIONS\n{' '.join(f'{x:.6f}' for x in model.begin)}{end}\n"


# -- categories --------------------------------------------------------------------------------------------------------


@dataclass
class CategoryMap:
    """Ranges of category numbers by type, in order, with precedences and conditions."""

    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    labelling: list[int] = field(default_factory=list)
    filling: list[int] = field(default_factory=list)
    conditions: dict[str, list[int]] = field(default_factory=dict)

    def category(self, kind: str) -> int:
        """First category of a type, 0 if there is none."""
        return self.ranges.get(kind, (0, 0))[0]

    def categories(self, names: list[str]) -> list[int]:
        """Numbers of types given by name, or by number as text."""
        out: list[int] = []
        for name in names:
            if name in self.ranges:
                out += range(self.ranges[name][0], self.ranges[name][1] + 1)
            elif name.isdigit():
                out.append(int(name))
        return out

    def feature(self, category: int) -> str:
        return next((k for k, (a, b) in self.ranges.items() if a <= category <= b), "background")

    def frame(self, spark: SparkSession) -> DataFrame:
        """feature, cat and precedence of each type; types without a precedence get -1."""
        order = {c: i for i, c in enumerate(self.labelling)}
        return spark.createDataFrame([(k, a, order.get(a, -1)) for k, (a, _) in self.ranges.items()], "feature string, cat int, precedence int")

    # conditioned types get one copy of their categories for each category they are conditioned on

    def unspooler(self) -> list[tuple[int, tuple[int, ...]]]:
        out: list[tuple[int, tuple[int, ...]]] = []
        for c in range(1 + max((b for _, b in self.ranges.values()), default=0)):
            under = self.conditions.get(self.feature(c), [])
            out += [(c, (u,)) for u in under] if under else [(c, ())]
        return out

    def unspool(self, spooled: list[int]) -> list[int]:
        """Conditioned states of a path, each by the last category before it that it is conditioned on."""
        states = self.unspooler()
        place = {s: i for i, s in enumerate(states)}
        out: list[int] = []
        for i, c in enumerate(spooled):
            under = self.conditions.get(self.feature(c), [])
            if not under:
                out.append(place[c, ()])
                continue
            before = next((spooled[j] for j in range(i - 1, -1, -1) if self.feature(spooled[j]) != self.feature(c)), None)
            out.append(place[c, (before if before in under else under[0],)])
        return out

    def spool(self, unspooled: list[int]) -> list[int]:
        states = self.unspooler()
        return [states[x][0] for x in unspooled]


def parse_category_map(text: str) -> CategoryMap:
    out = CategoryMap()
    for line in re.split(r"[\n;]", text):
        line = line.split("#")[0].strip()
        if m := re.match(r"^(LABELLING|FILL)_PRECEDENCE\s*=\s*\{?\s*([-0-9,\s]*)\}?", line):
            numbers = [int(x) for x in re.findall(r"-?\d+", m[2])]
            if m[1] == "LABELLING":
                out.labelling = numbers
            else:
                out.filling = numbers
        elif m := re.match(r"^(\S+)\s+(\d+)(?:-(\d+))?(?:\s+\{\s*(.*?)\s*\})?$", line):
            out.ranges[m[1]] = (int(m[2]), int(m[3] or m[2]))
            if m[4]:
                out.conditions[m[1]] = [int(x) for x in re.findall(r"\d+", m[4])]
    return out


def category_map_text(cm: CategoryMap) -> str:
    lines = [f"NCATS = {max((b for _, b in cm.ranges.values()), default=0)}", ""]
    lines += [f"{k}\t{a}" + (f"-{b}" if b > a else "") + (f"\t{{ {','.join(map(str, cm.conditions[k]))} }}" if k in cm.conditions else "") for k, (a, b) in cm.ranges.items()]
    lines += [f"{name}_PRECEDENCE = {{ {','.join(map(str, v))} }}" for name, v in (("LABELLING", cm.labelling), ("FILL", cm.filling)) if v]
    return "\n".join(lines) + "\n"


def categories_from_features(feats: DataFrame, order: str, most: int = 10_000) -> CategoryMap:
    """One category for each type, numbered from 1 in the order of first sight; more than `most` are refused."""
    from tessera.operators.intervals import partition_by_type

    kinds = [r["feature"] for r in partition_by_type(feats, order).limit(most + 1).collect()]
    if len(kinds) > most:
        raise ValueError(f"more than {most} types")
    return CategoryMap({k: (i + 1, i + 1) for i, k in enumerate(kinds)}, list(range(1, len(kinds) + 1)))


# -- matrices ----------------------------------------------------------------------------------------------------------


def parse_matrix(text: str) -> np.ndarray:
    return np.array([[float(x) for x in line.split()] for line in text.split("\n") if line.strip() and not line.startswith("#")])


def parse_vector(text: str) -> np.ndarray:
    return np.array(text.split(), float)


def matrix_text(m: np.ndarray) -> str:
    return "\n".join(" ".join(f"{x:g}" for x in row) for row in np.atleast_2d(m)) + "\n"


def parse_pwm(text: str, alphabet: str = "ACGT") -> list[tuple[int, str, float]]:
    """(at, sym, p) of rows of four columns; other lines are skipped."""
    rows = [[float(x) for x in line.split()] for line in text.split("\n") if re.match(r"^\s*[0-9.]+(\s+[0-9.]+){3}\s*$", line)]
    return [(i, a, p) for i, row in enumerate(rows) for a, p in zip(alphabet, row)]


def parse_substitution_scores(text: str) -> dict[tuple[str, str], float]:
    """A square table with symbols as heads."""
    rows = [line.split() for line in text.split("\n") if line.strip() and not line.startswith("#")]
    return {(row[0], b): float(x) for row in rows[1:] for b, x in zip(rows[0], row[1:])}


# -- probability codes -------------------------------------------------------------------------------------------------


def parse_codes(text: str) -> np.ndarray:
    """A code book: rows of an index and probabilities."""
    rows = [line.split() for line in text.split("\n") if re.match(r"^\s*[0-9]+\s+[0-9.]", line)]
    return np.array([[float(x) for x in r[1:]] for r in rows])


def codes_text(codes: np.ndarray) -> str:
    return "\n".join(f"{i}\t" + "\t".join(f"{x:.6f}" for x in c) for i, c in enumerate(codes)) + "\n"


def pack_codes(indices: np.ndarray, n_codes: int) -> bytes:
    """Indices as fixed-width big-endian integers of as few bytes as their number needs."""
    width = max(1, (int(n_codes - 1).bit_length() + 7) // 8)
    return b"".join(int(i).to_bytes(width, "big") for i in indices)


def unpack_codes(data: bytes, n_codes: int) -> np.ndarray:
    width = max(1, (int(n_codes - 1).bit_length() + 7) // 8)
    return np.array([int.from_bytes(data[i : i + width], "big") for i in range(0, len(data), width)])
