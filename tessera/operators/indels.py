"""Gaps on trees: patterns, parsimonious histories and rates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.trees import Node, lca


def ancestral_presence(tree: Node, present: dict[str, bool | None]) -> dict[int, bool]:
    """Whether each node has a base, by least changes; ties go to presence below the common ancestor of the leaves that have one.

    A base stands in a node if it lies at or below the ancestor of all leaves that have one and parsimony allows it.
    """
    have = [leaf for leaf in tree.leaves() if present.get(leaf.name)]
    top = lca(have) if have else None
    inside = {id(n) for n in top.preorder()} if top is not None else set()
    sets: dict[int, set[bool]] = {}
    for n in tree.postorder():
        if not n.children:
            x = present.get(n.name)
            sets[n.id] = {True, False} if x is None else {x}
        else:
            common = set.intersection(*[sets[c.id] for c in n.children])
            sets[n.id] = common or set.union(*[sets[c.id] for c in n.children])
        if id(n) not in inside:
            sets[n.id] = {False}
    out: dict[int, bool] = {}
    for n in tree.preorder():
        above = out.get(n.parent.id) if n.parent is not None else None
        out[n.id] = above if above in sets[n.id] else (True if True in sets[n.id] else False)
    return out


def events(tree: Node, column: str, names: Sequence[str]) -> list[tuple[int, str]]:
    """(node below the branch, 'insertion' or 'deletion') that explain a column's gaps."""
    here = {n: None if c in "*N" else c != "-" for n, c in zip(names, column)}
    state = ancestral_presence(tree, here)
    return [(n.id, "insertion" if state[n.id] else "deletion") for n in tree.preorder() if n.parent is not None and state[n.id] != state[n.parent.id]]


def gap_pattern(tree: Node, column: str, names: Sequence[str]) -> tuple[str, int]:
    """('null', -1), ('insertion' or 'deletion', node) if one event explains the column, else ('complex', -1)."""
    found = events(tree, column, names)
    if not found:
        return "null", -1
    return (found[0][1], found[0][0]) if len(found) == 1 else ("complex", -1)


def gap_patterns(tuples: DataFrame, names: Sequence[str], tree: Node) -> DataFrame:
    """tuple, pattern and node of every distinct tuple."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [gap_pattern(tree, t, names) for t in pdf["tuple"]]
            yield pd.DataFrame({"tuple": pdf["tuple"].to_numpy(), "pattern": [p for p, _ in found], "node": [n for _, n in found]})

    return tuples.select("tuple").distinct().mapInPandas(run, "tuple string, pattern string, node int")


def history(columns: DataFrame, names: Sequence[str], tree: Node, by: Sequence[str] = ("aln",)) -> DataFrame:
    """by, node, kind, start, end: runs of neighbouring columns in which a branch has the same event.

    Events are found once for each distinct gap pattern, joined back, and joined into runs.
    """
    from tessera.operators.intervals import merge_overlapping

    shape = F.regexp_replace("col", "[^*-]", "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, n, k) for t in pdf["shape"] for n, k in events(tree, t, names)]
            yield pd.DataFrame(rows, columns=["shape", "node", "kind"])

    found = columns.select(shape.alias("shape")).distinct().mapInPandas(run, "shape string, node int, kind string")
    met = columns.withColumn("shape", shape).join(found, "shape").select(*by, "node", "kind", F.col("pos").alias("start"), F.col("pos").alias("end"))
    return merge_overlapping(met, by=(*by, "node", "kind"), adjacent=True)


def branch_rates(runs: DataFrame, length: int) -> dict[int, dict[str, float]]:
    """Per branch: insertion and deletion events per column, and the chance that an event goes on by one more column."""
    rows = runs.groupBy("node", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("l")).collect()  # two rows for each branch
    out: dict[int, dict[str, float]] = {}
    whole: Counter = Counter()
    count: Counter = Counter()
    for r in rows:
        out.setdefault(r["node"], {})["alpha" if r["kind"] == "insertion" else "beta"] = r["n"] / length
        whole[r["node"]] += r["l"]
        count[r["node"]] += r["n"]
    for node, x in out.items():
        x.setdefault("alpha", 0.0)
        x.setdefault("beta", 0.0)
        x["tau"] = 1 - count[node] / whole[node] if whole[node] else 0.0
    return out


def log_likelihood(runs: list[tuple[int, str, int]], rates: dict[int, dict[str, float]], length: int) -> float:
    """log2 chance of runs (node, kind, columns): an event starts with its rate and goes on geometrically."""
    total = 0.0
    for node, x in rates.items():
        mine = [(k, n) for v, k, n in runs if v == node]
        busy = sum(n for _, n in mine)
        quiet = max(0, length - busy)
        total += quiet * np.log2(max(1e-300, 1 - x["alpha"] - x["beta"]))
        for kind, n in mine:
            total += np.log2(max(1e-300, x["alpha" if kind == "insertion" else "beta"])) + (n - 1) * np.log2(max(1e-300, x["tau"])) + np.log2(max(1e-300, 1 - x["tau"]))
    return float(total)
