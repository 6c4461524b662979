"""Features predicted on both strands, with and without gap laws."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import models as md
from tessera.functions.models import TreeModel
from tessera.operators import categories, hmm, trees
from tessera.operators import likelihood as lk

NAMES = ["a", "b", "c"]


def models():
    tree = trees.number(trees.parse("((a:0.1,b:0.1):0.1,c:0.2);"))
    flat, rich = np.full(4, 0.25), np.array([0.55, 0.25, 0.15, 0.05])
    return [TreeModel(tree, md.f81(flat), flat), TreeModel(tree, md.f81(rich), rich)]


def test_features_on_both_strands(spark):
    rng, letters, rows, want = np.random.default_rng(4), np.array(list("ACGT")), [], []
    background, rich = models()
    for k in range(30):
        for m, n, strand in ((background, 80, None), (rich, 40, "+-"[k % 2])):
            cols = ["".join(r) for r in letters[lk.simulate(m, n, rng)]]
            if strand:
                want.append((len(rows) + 1, len(rows) + n, strand))
            if strand == "-":
                cols = [c.translate(categories._OTHER) for c in cols]
            rows += [("s", len(rows) + i + 1, c) for i, c in enumerate(cols)]
    columns = spark.createDataFrame(rows, "aln string, pos long, col string").repartition(3).cache()
    chain = hmm.Hmm(np.array([[1 - 1 / 80, 1 / 80], [1 / 40, 1 - 1 / 40]]), np.array([0.9, 0.1]))
    found = categories.predict_features(columns, NAMES, models(), chain, {1: "gene"}, pivots=[0], size=256).collect()
    assert {r["feature"] for r in found} == {"gene"} and all(r["n"] == r["end"] - r["start"] + 1 for r in found)
    hits = sum(any(r["strand"] == s and r["start"] <= b and r["end"] >= a for r in found) for a, b, s in want)
    assert hits >= 27 and len(found) < 40
    p = {r["pos"]: r["p"] for r in categories.category_posteriors(columns, NAMES, models(), chain, [1], pivots=[0], size=256).collect()}
    inside = [p[i] for a, b, _ in want for i in range(a, b + 1)]
    assert len(p) == len(rows) and np.mean(inside) > 0.8 > 0.3 > (sum(p.values()) - sum(inside)) / (len(rows) - len(inside))


def test_gap_laws_tell_categories_apart(spark):
    cols = ["AAA", "A-A", "AAA", "-AA"] * 10 + ["AAA"] * 40
    columns = spark.createDataFrame([("s", i + 1, c) for i, c in enumerate(cols)], "aln string, pos long, col string")
    same = [models()[0]] * 2
    chain = hmm.Hmm(np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([0.5, 0.5]))
    laws = [{"null": 0.98, "deletion": 0.01, "insertion": 0.01}, {"null": 0.5, "deletion": 0.25, "insertion": 0.25}]
    found = categories.predict_features(columns, NAMES, same, chain, {1: "loose"}, gap_laws=laws).collect()
    assert len(found) == 1 and found[0]["start"] <= 2 and 38 <= found[0]["end"] <= 42 and found[0]["strand"] == "+"


def test_paths_become_features(spark):
    path = spark.createDataFrame([("x", i + 1, s) for i, s in enumerate([0, 1, 1, 2, 2, 3, 0, 1])], "aln string, pos long, state int")
    got = sorted((r["start"], r["end"], r["feature"], r["strand"]) for r in categories.features_of_path(path, [(None, "+"), ("e", "+"), ("e", "+"), ("e", "-")], ["aln"]).collect())
    assert got == [(2, 5, "e", "+"), (6, 6, "e", "-"), (8, 8, "e", "+")]
    assert categories.features_of_path(path.limit(0), [("e", "+")], ["aln"]).count() == 0


def test_scores_are_of_complemented_columns(spark):
    d = spark.createDataFrame([("ACG",), ("TTT",), ("A-N",)], "tuple string")
    m = models()
    got = {r["col"]: r["emission"] for r in categories.state_scores(d, NAMES, m, [(0, 0), (1, 0), (1, 1)]).collect()}
    for col, other in (("ACG", "TGC"), ("TTT", "AAA"), ("A-N", "T-N")):
        want = [lk.column_loglik(x, lk.encode([t], NAMES, x.tree.leaf_names()))[0] / np.log(2) for x, t in ((m[0], col), (m[1], col), (m[1], other))]
        assert got[col] == pytest.approx(want)
