"""End-user entry points: one function for each whole analysis, over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions as ds
from tessera.functions import models as md
from tessera.functions.models import TreeModel
from tessera.operators import estimation, hmm, indels, substitutions, trees, tuples, windows
from tessera.operators import likelihood as lk
from tessera.operators.hmm import Hmm
from tessera.operators.trees import Node
from tessera.runtime import stage, unstage


def fit_models(columns: DataFrame, names: Sequence[str], tree: Node, kind: str = "REV", classes: int = 1, by: str | None = None) -> dict[object, tuple[TreeModel, float]]:
    """A fitted model for the whole alignment, or for each value of a category column (few by nature)."""
    counted = tuples.tuple_counts(columns.withColumn("tuple", F.col("col")), [] if by is None else [by])
    if by is None:
        return {None: lk.fit(counted, names, tree, kind, classes)}
    values = [r[by] for r in counted.select(by).distinct().collect()]
    return {v: lk.fit(counted.filter(F.col(by) == v), names, tree, kind, classes) for v in values}


def fit_windows(columns: DataFrame, names: Sequence[str], tree: Node, size: int, shift: int, kind: str = "HKY85") -> DataFrame:
    """aln, start, end, gc, loglik, n_informative and tree_length of hopping windows: each window is fitted in one task from its counted tuples."""
    spread = windows.hopping(columns, "pos", size, shift, ["aln", "col"], [F.count(F.lit(1)).alias("cnt")])
    leaves = tree.leaf_names()
    text = trees.newick(tree)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = trees.parse(text)
        cols, n = pdf["col"].tolist(), pdf["cnt"].to_numpy(float)
        codes = lk.encode(cols, names, leaves)
        pi = np.maximum(lk.base_frequencies(cols, n), 1e-6)
        pi /= pi.sum()
        informative = float(n[(codes >= 0).sum(1) >= 2].sum())

        def model(x: np.ndarray) -> TreeModel:
            return TreeModel(t, lk.rate_matrix(kind, pi, np.exp(x[1:])), pi, scale=float(np.exp(x[0])))

        x, value = lk.bfgs(lambda x: -float(n @ lk.column_loglik(model(x), codes)), np.r_[0.0, np.log(lk.first_values(kind))], low=-8.0, high=4.0, rounds=40)
        return pd.DataFrame([{"aln": str(pdf["aln"].iloc[0]), "start": int(pdf["start"].iloc[0]), "end": int(pdf["end"].iloc[0]), "gc": float(pi[1] + pi[2]), "loglik": -value, "n_informative": informative, "tree_length": t.total_length() * float(np.exp(x[0]))}])

    return spread.groupBy("aln", "start", "end").applyInPandas(run, "aln string, start long, end long, gc double, loglik double, n_informative double, tree_length double")


def conserved(columns: DataFrame, names: Sequence[str], model: TreeModel, **options) -> tuple[DataFrame, DataFrame]:
    """Posterior of conservation by position and the conserved elements."""
    return lk.conserved_posteriors(columns, names, model, **options)


def fit_conserved(columns: DataFrame, names: Sequence[str], model: TreeModel, rho: float = 0.3, coverage: float = 0.3, length: float = 45.0, rounds: int = 10, size: int = 4096) -> tuple[Hmm, float]:
    """The two-state chain's transitions by expectation-maximisation, with its log2 likelihood; estimation.fit_conserved also finds rho and the trees."""
    fitted = estimation.fit_chain(columns, names, [lk.conserved_model(model, rho), model], hmm.two_state(coverage, length), ("transitions",), rounds=rounds, size=size)
    return fitted.chain, fitted.history[-1]


def rate_classes(columns: DataFrame, names: Sequence[str], model: TreeModel, keep: float = 0.9, size: int = 4096) -> DataFrame:
    """aln, pos and posterior over the model's rate classes under an autocorrelated chain."""
    one = [model.with_(rates=np.array([r]), weights=np.ones(1)) for r in model.rates]
    d = columns.select(F.col("col").alias("tuple")).distinct()
    for i, m in enumerate(one):
        d = lk.score_tuples(d, names, m).withColumnRenamed("loglik", f"_e{i}")
    e = d.select(F.col("tuple").alias("col"), F.array(*[F.col(f"_e{i}") / np.log(2.0) for i in range(len(one))]).alias("emission"))
    rows = columns.join(e, "col").select("aln", "pos", "emission")
    return hmm.posterior(rows, hmm.autocorrelated(len(one), keep), ("aln",), size)


def site_tests(columns: DataFrame, names: Sequence[str], model: TreeModel, method: str = "LRT", mode: str = "CONACC", subtree: str | None = None) -> DataFrame:
    """Every position with the statistics of its column: LRT, SCORE or SPH (also of a subtree) or GERP; each distinct column is tested once."""
    distinct = columns.select(F.col("col").alias("tuple"))
    if method == "SPH":
        found = substitutions.test_sites(distinct, names, model) if subtree is None else substitutions.test_subtrees(distinct, names, model, subtree)
    else:
        found = lk.test_tuples(distinct, names, model, method, mode, subtree)
    return columns.join(found.withColumnRenamed("tuple", "col"), "col")


def feature_tests(columns: DataFrame, feats: DataFrame, names: Sequence[str], model: TreeModel, by: Sequence[str], method: str = "SPH", mode: str = "CONACC", subtree: str | None = None) -> DataFrame:
    """Features with the statistics of their columns: SPH (substitution counts), LRT or SCORE (also of a subtree) or GERP; feats: aln, start, end and by."""
    from tessera.operators.intervals import overlap_pairs

    points = columns.withColumn("start", F.col("pos")).withColumn("end", F.col("pos"))
    met = overlap_pairs(points, feats, ("aln",)).select(*[F.col(f"r_{k}").alias(k) for k in by], "col")
    return substitutions.test_features(met, names, model, by, subtree) if method == "SPH" else lk.test_features(met, names, model, by, method, mode, subtree)


def ancestral_bases(columns: DataFrame, names: Sequence[str], model: TreeModel) -> DataFrame:
    """aln, pos, node, base and p; bases that an ancestor lacks by parsimony of gaps get p = -1."""
    post = lk.ancestors(columns.select(F.col("col").alias("tuple")), names, model)
    tree = trees.name_ancestors(trees.copy(model.tree))
    label = {n.id: m.name for n, m in zip(model.tree.preorder(), tree.preorder())}
    inner = {n.id: n.name or str(n.id) for n in model.tree.preorder() if n.children}

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf["tuple"]:
                state = indels.ancestral_presence(model.tree, {n: None if c in "*N" else c != "-" for n, c in zip(names, t)})
                rows += [(t, inner[i], label[i], state[i]) for i in inner]
            yield pd.DataFrame(rows, columns=["tuple", "node", "name", "there"])

    there = columns.select(F.col("col").alias("tuple")).distinct().mapInPandas(run, "tuple string, node string, name string, there boolean")
    met = post.join(there, ["tuple", "node"]).select(F.col("tuple").alias("col"), F.col("name").alias("node"), "base", F.when(F.col("there"), F.col("p")).otherwise(-1.0).alias("p"))
    return columns.join(met, "col")


def simulate(spark: SparkSession, model: TreeModel, length: int, seed: int, chain: Hmm | None = None, scales: Sequence[float] = (1.0,), block: int = 65_536) -> DataFrame:
    """aln, pos, col and state of a simulated alignment; blocks are drawn in parallel, each with a seed of its own.

    With a chain, each position's scale follows its states. The states at the blocks' first positions are drawn in their order, and each block's
    others given both its borders, so that runs go on from block to block.
    """
    n_blocks = -(-length // block)
    blocks = spark.range(0, n_blocks, 1).withColumnRenamed("id", "b")
    borders = [] if chain is None else _border_states(chain.transition, n_blocks, block, np.random.default_rng([seed, 1 << 32]))

    def run(batches):
        for pdf in batches:
            for b in pdf["b"]:
                n = min(block, length - int(b) * block)
                rng = np.random.default_rng([seed, int(b)])
                state = np.zeros(n, int)
                if chain is not None:
                    state = _between(chain.transition, borders[b], borders[b + 1] if b + 1 < n_blocks else None, n, rng)
                codes = np.zeros((n, len(model.tree.leaves())), int)
                for s in np.unique(state):
                    codes[state == s] = lk.simulate(model.with_(scale=model.scale * scales[s]), int((state == s).sum()), rng)
                letters = np.array(list(model.alphabet))[codes]
                yield pd.DataFrame({"aln": "sim", "pos": int(b) * block + 1 + np.arange(n), "col": ["".join(r) for r in letters], "state": state})

    return blocks.mapInPandas(run, "aln string, pos long, col string, state int")


def _border_states(t: np.ndarray, blocks: int, size: int, rng: np.random.Generator) -> list[int]:
    """The states of a stationary chain at the first position of every block; one number for each block."""
    pi, step = np.clip(hmm.stationary(t), 0, None), np.linalg.matrix_power(t, size)
    out = [int(rng.choice(len(t), p=pi / pi.sum()))]
    while len(out) < blocks:
        p = np.clip(step[out[-1]], 0, None)
        out.append(int(rng.choice(len(t), p=p / p.sum())))
    return out


def _between(t: np.ndarray, first: int, after: int | None, n: int, rng: np.random.Generator) -> np.ndarray:
    """n states of a chain from `first` on, given the one after the last if there is one: drawn backwards over forward chances."""
    forward = np.zeros((n, len(t)))
    forward[0, first] = 1.0
    for i in range(1, n):
        forward[i] = forward[i - 1] @ t
    state, u, last = np.zeros(n, int), rng.random(n), after
    for i in range(n - 1, -1, -1):
        p = forward[i] if last is None else forward[i] * t[:, last]
        cum = np.cumsum(p)
        last = state[i] = min(int((u[i] * cum[-1] > cum).sum()), len(t) - 1)
    return state


def bootstrap(columns: DataFrame, names: Sequence[str], tree: Node, kind: str = "HKY85", rounds: int = 20, seed: int = 1) -> dict[str, dict[str, float]]:
    """Summary of each branch length over resampled tuple counts.

    In every round a tuple's count is drawn by a Poisson law of its own, by a seed from the round and the tuple: the same draws at
    any size and in any partitioning. Given their sum such counts are a multinomial sample.
    """
    counted = stage(tuples.tuple_counts(columns.withColumn("tuple", F.col("col"))).select("tuple", "cnt"), "bootstrap")

    def drawn(k: int) -> DataFrame:
        def draw(batches):
            for pdf in batches:
                c = [np.random.default_rng([seed, k, *t.encode()]).poisson(x) for t, x in zip(pdf["tuple"], pdf["cnt"])]
                yield pdf.assign(cnt=np.array(c, np.int64)).query("cnt > 0")

        return stage(counted.mapInPandas(draw, "tuple string, cnt long"), "bootstrap")

    seen: dict[str, list[float]] = {}
    for k in range(rounds):
        table = drawn(k)
        fitted, _ = lk.fit(table, names, tree, kind)
        unstage(table)
        for node in trees.name_ancestors(fitted.tree).preorder():
            if node.parent is not None:
                seen.setdefault(node.name, []).append(node.length)
    return {k: ds.summary(np.array(v)) for k, v in seen.items()}


def entropies(chain: Hmm, slow: TreeModel, fast: TreeModel, columns: int = 20_000, seed: int = 1) -> dict[str, float]:
    """Relative entropy (bits) of conserved columns against others, by simulation, and the expected lengths that give it its product."""
    codes = lk.simulate(slow, columns, np.random.default_rng(seed))
    h = float((lk.column_loglik(slow, codes) - lk.column_loglik(fast, codes)).mean() / np.log(2))
    length = 1 / chain.transition[0, 1]
    nu, mu = chain.transition[1, 0], chain.transition[0, 1]
    least = (np.log2(nu) + np.log2(mu) - np.log2(1 - nu) - np.log2(1 - mu)) / (np.log2(1 - nu) - np.log2(1 - mu) - h)
    return {"entropy": h, "expected_length": length, "product": h * length, "least_length": float(least), "most_length": float(least)}


def biased_chain(model: TreeModel, rho: float = 0.3, bias: float = 3.0, selection: float = 0.0) -> list[TreeModel]:
    """Four models: neutral and conserved, each without and with GC-biased conversion."""
    strong = model.with_(q=md.biased(model.q, selection, bias))
    return [model, lk.conserved_model(model, rho), strong, lk.conserved_model(strong, rho)]


def biased_tracts(columns: DataFrame, names: Sequence[str], model: TreeModel, bias: float = 3.0, coverage: float = 0.01, length: float = 1000.0, size: int = 4096) -> DataFrame:
    """Runs of the biased states of the best path through conserved x biased, as aln, start, end, n."""
    states = biased_chain(model, bias=bias)
    chain = hmm.cross_product(hmm.two_state(coverage, length), hmm.two_state(0.3, 45.0))
    order = [states[3], states[2], states[1], states[0]]  # biased first, and conserved first inside
    d = columns.select(F.col("col").alias("tuple")).distinct()
    for i, m in enumerate(order):
        d = lk.score_tuples(d, names, m).withColumnRenamed("loglik", f"_e{i}")
    e = d.select(F.col("tuple").alias("col"), F.array(*[F.col(f"_e{i}") / np.log(2.0) for i in range(4)]).alias("emission"))
    path = hmm.best_path(columns.join(e, "col").select("aln", "pos", "emission"), chain, ("aln",), size)
    from tessera.operators.intervals import run_lengths

    runs = run_lengths(path.withColumn("biased", F.col("state") < 2), ("aln",), "pos", "biased")
    return runs.filter("biased").select("aln", "start", "end", "n")


def lineage_chain(tree: Node, phi: float = 0.5, mu: float = 0.01, nu: float = 0.01) -> tuple[Hmm, list[str]]:
    """States: neutral, conserved everywhere, and for each branch born or lost there; elements start with nu, end with mu, and a share phi of them is lineage-specific."""
    branches = [n.name or str(n.id) for n in tree.preorder() if n.parent is not None]
    names = ["neutral", "conserved", *[f"birth:{b}" for b in branches], *[f"death:{b}" for b in branches]]
    start = np.r_[1 - phi, np.full(2 * len(branches), phi / (2 * len(branches)))]
    t = np.zeros((len(names), len(names)))
    t[0, 0], t[0, 1:] = 1 - nu, nu * start
    for i in range(1, len(names)):
        t[i, i], t[i, 0] = 1 - mu, mu
    pi = np.r_[mu, nu * start] / (mu + nu)
    return Hmm(t, pi), names


def tree_doctor(text: str, prune: Sequence[str] = (), keep: Sequence[str] = (), rename: dict[str, str] | None = None, scale: float = 1.0, reroot: str | None = None, name_ancestors: bool = False) -> str:
    """A Newick tree after the asked changes, in this order."""
    t = trees.parse(text)
    if prune or keep:
        t, _ = trees.prune(t, keep or prune, keep=bool(keep))
    for n in t.preorder():
        n.name = (rename or {}).get(n.name, n.name)
    trees.scale(t, scale)
    if reroot:
        t = trees.reroot(t, reroot)
    return trees.newick(trees.name_ancestors(t) if name_ancestors else t)
