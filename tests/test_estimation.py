"""Joint fits, expectation-maximisation, chains with their models, altered branches and site classes."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from tessera.functions import models as md
from tessera.functions.models import TreeModel
from tessera.operators import estimation as es
from tessera.operators import hmm, trees
from tessera.operators import likelihood as lk
from tessera.plans import programs
from tessera.runtime import staged_paths

NAMES = ["a", "b", "c", "d"]
PI = np.array([0.3, 0.2, 0.2, 0.3])


def model(text="((a:0.12,b:0.2):0.1,(c:0.05,d:0.3):0.08);", kappa=3.0, **more):
    return TreeModel(trees.number(trees.parse(text)), md.hky85(PI, kappa), PI, kind="HKY85", free=np.array([kappa]), **more)


def drawn(m, n, seed=1):
    letters = np.array(list("ACGT"))[lk.simulate(m, n, np.random.default_rng(seed))]
    found, counts = np.unique(["".join(r) for r in letters], return_counts=True)
    return [(str(t), int(c)) for t, c in zip(found, counts)]


def table(spark, rows, ddl="tuple string, cnt double"):
    return spark.createDataFrame([(*r[:-1], float(r[-1])) for r in rows], ddl)


def by_names(m):
    """A column's probability by summing over the states of all inner nodes."""
    inner = [n for n in m.tree.preorder() if n.children]
    leaves = m.tree.leaves()

    def p(column):
        total = 0.0
        for r, w in enumerate(m.weights):
            for states in product(range(len(m.pi)), repeat=len(inner)):
                state = {n.id: s for n, s in zip(inner, states)} | {n.id: s for n, s in zip(leaves, column)}
                x = m.pi[state[m.tree.id]]
                for n in m.tree.preorder():
                    if n.parent is not None:
                        x *= m.probabilities(n)[r][state[n.parent.id], state[n.id]]
                total += w * x
        return total

    return p


def test_branch_changes_by_enumeration():
    m = model("((a:0.3,b:0.5):0.4,c:0.7);", rates=np.array([0.5, 1.5]), weights=np.array([0.4, 0.6]))
    codes = np.array(list(product(range(4), repeat=3)))[::5]
    weights = np.arange(1.0, len(codes) + 1)
    found, total = es.branch_changes(m, codes, weights)
    nodes = list(m.tree.preorder())
    inner, leaves = [n for n in nodes if n.children], m.tree.leaves()
    want = {n.id: np.zeros((2, 4, 4)) for n in nodes if n.parent}
    loglik = 0.0
    for column, w in zip(codes, weights):
        each = {}
        for r in range(2):
            for states in product(range(4), repeat=len(inner)):
                s = {n.id: x for n, x in zip(inner, states)} | {n.id: x for n, x in zip(leaves, column)}
                p = m.weights[r] * m.pi[s[m.tree.id]] * np.prod([m.probabilities(n)[r][s[n.parent.id], s[n.id]] for n in nodes if n.parent])
                each[r, tuple(s.items())] = p
        whole = sum(each.values())
        loglik += w * np.log(whole)
        for (r, s), p in each.items():
            s = dict(s)
            for n in nodes:
                if n.parent:
                    want[n.id][r, s[n.parent.id], s[n.id]] += w * p / whole
    assert total == pytest.approx(loglik)
    for k, x in want.items():
        assert np.allclose(found[k], x)


@pytest.mark.parametrize("kind, classes", [("HKY85", 1), ("REV", 1), ("F81", 1), ("HKY85", 3)])
def test_em_reaches_the_fit_and_never_falls(spark, kind, classes):
    truth = model() if classes == 1 else TreeModel.gamma(model().tree, model().q, PI, 0.7, 3)
    counts = table(spark, drawn(truth, 4000)).cache()
    start = trees.parse("((a:0.3,b:0.3):0.3,(c:0.3,d:0.3):0.3);")
    found, history = es.fit_em(counts, NAMES, start, kind, classes=classes, tolerance=1e-6)
    m, value = lk.fit(counts, NAMES, start, kind, classes)
    assert min(np.diff(history)) > -1e-6 and history[-1] == pytest.approx(value, abs=2e-2)
    assert [n.length for n in found[""].tree.preorder()] == pytest.approx([n.length for n in m.tree.preorder()], abs=0.02)


def test_driver_and_cluster_agree(spark, monkeypatch):
    """The same weighted tuples, evaluated on the driver and by jobs, frequencies included."""
    counts = table(spark, [("AAAA", 50.0), ("AAAC", 3.0), ("CCCC", 1.5), ("GGGA", 2.0), ("TTTT", 20.0), ("AC-T", 1.0)]).repartition(3)
    tree = trees.parse("((a:0.1,b:0.1):0.1,c:0.1,d:0.1);")
    here = lk.fit(counts, NAMES, tree, "HKY85")
    em_here = es.fit_em(counts, NAMES, tree, "HKY85", rounds=4)[1]
    monkeypatch.setattr(lk, "MOST_TUPLES", 2)
    there = lk.fit(counts, NAMES, tree, "HKY85")
    em_there = es.fit_em(counts, NAMES, tree, "HKY85", rounds=4)[1]
    assert here[1] == pytest.approx(there[1], abs=1e-6) and np.allclose(here[0].pi, there[0].pi)
    assert np.allclose(here[0].pi, np.array([212, 10, 6, 81]) / 309)
    assert em_here == pytest.approx(em_there, abs=1e-6)


def test_joint_fits(spark):
    one, two = drawn(model(), 3000, 1), drawn(model(kappa=6.0, scale=0.4), 3000, 2)
    both = table(spark, [("x", *r) for r in one] + [("y", *r) for r in two], "grp string, tuple string, cnt double").cache()
    tree = trees.parse("((a:0.1,b:0.1):0.1,(c:0.1,d:0.1):0.1);")
    apart, value = es.fit_parts(both, NAMES, tree, "HKY85", "grp", shared=())
    alone = [lk.fit(both.filter(f"grp = '{g}'"), NAMES, tree, "HKY85") for g in "xy"]
    assert value == pytest.approx(sum(v for _, v in alone), abs=1e-2)
    for g, (m, _) in zip("xy", alone):
        assert [n.length for n in apart[g].tree.preorder()] == pytest.approx([n.length for n in m.tree.preorder()], abs=5e-3)
    scaled, less = es.fit_parts(both, NAMES, tree, "HKY85", "grp", shared=("branches",), scaled=("y",))
    assert less < value + 1e-6 and value - less < 15  # the simulated parts differ by a scale and kappa alone
    assert scaled["y"].scale == pytest.approx(0.4, abs=0.06) and scaled["y"].free[0] == pytest.approx(6, abs=1.5) and scaled["x"].free[0] == pytest.approx(3, abs=0.6)
    fixed, _ = es.fit_parts(both, NAMES, tree, "HKY85", "grp", shared=("branches", "rates"), free=("rates",))
    assert [n.length for n in fixed["x"].tree.preorder()] == pytest.approx([n.length for n in trees.parse(trees.newick(tree)).preorder()], abs=1e-6)


def test_standard_errors_agree_with_the_bootstrap(spark):
    rows = drawn(model(), 3000)
    counts = table(spark, rows).cache()
    m, _ = lk.fit(counts, NAMES, trees.parse("((a:0.1,b:0.1):0.1,(c:0.1,d:0.1):0.1);"), "HKY85")
    found = es.standard_errors(counts, NAMES, m).set_index("name")
    rng, n = np.random.default_rng(3), np.array([c for _, c in rows], float)
    codes = lk.encode([t for t, _ in rows], NAMES, m.tree.leaf_names())
    parameters = es.Parameters(m.tree, "HKY85", {"": m.pi}, {"": 1}, rates=m.free)
    low, high = parameters.bounds()
    draws = []
    for _ in range(60):
        c = rng.multinomial(int(n.sum()), n / n.sum())
        draws.append(np.exp(lk.bfgs(lambda x: -float(c @ lk.column_loglik(parameters.models(x)[""], codes)), parameters.vector(), low=low, high=high)[0]))  # noqa: B023
    assert found["error"].to_numpy() == pytest.approx(np.std(draws, axis=0), rel=0.35)
    assert list(found.index) == parameters.names() and found.loc["rates:0", "value"] == pytest.approx(m.free[0])


def test_conserved_chain_returns_rho_and_trees(spark):
    truth = model("((a:0.3,b:0.4):0.2,(c:0.25,d:0.5):0.2);")
    sim = programs.simulate(spark, truth, 12_000, 5, hmm.two_state(0.4, 60.0), (0.25, 1.0), block=12_000).cache()
    fit = es.fit_conserved(sim, NAMES, truth, rho=0.6, coverage=0.2, length=20.0, rounds=12, size=1000)
    assert min(np.diff(fit.history)) > -1e-6
    assert fit.models[0].scale == pytest.approx(0.25, abs=0.04) and fit.models[1].scale == 1.0
    assert 1 / fit.chain.transition[0, 1] == pytest.approx(60, rel=0.35)
    start = model("((a:0.2,b:0.2):0.3,(c:0.2,d:0.2):0.1);", kappa=1.5)
    whole = es.fit_conserved(sim, NAMES, start, rho=0.5, trees=True, rounds=12, size=1000)
    assert min(np.diff(whole.history)) > -1e-6 and whole.history[-1] > fit.history[-1] - 5
    assert whole.models[0].scale == pytest.approx(0.25, abs=0.06)
    assert [n.length for n in whole.models[1].tree.leaves()] == pytest.approx([0.3, 0.4, 0.25, 0.5], abs=0.1)
    assert whole.models[1].free[0] == pytest.approx(3, rel=0.25)


def test_packed_chunks_give_the_expected_tables(spark):
    """Sequences of one row, of part of a chunk and of several; a step that can't be taken; one chunk each without borders."""
    rng = np.random.default_rng(8)
    scores = np.log2(rng.random((6, 3)))
    chain = hmm.Hmm(np.array([[0.9, 0.1, 0.0], [0.2, 0.7, 0.1], [0.3, 0.0, 0.7]]), np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.2, 0.3]))
    rows = [(f"s{n}", i + 1, int(k)) for n in (1, 2, 19, 20, 21, 40, 41, 67) for i, k in enumerate(rng.integers(0, 6, n))]
    rows = spark.createDataFrame(rows, "seq string, pos long, sym long")
    scored = rows.join(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(scores)], "sym long, emission array<double>"), "sym")
    for size, several in ((20, True), (100, False), (100, True)):
        steps, begins, total, table_ = hmm.expected_tables(scored, chain, "sym", size=size)
        sums = hmm.expected_packed(hmm.packed(rows, "sym", size=size).cache(), chain, "sym", scores, ("seq",), several)
        for found, known in zip(hmm.counts_of(sums, "sym", 3), (steps, begins, total)):
            assert found == pytest.approx(known, rel=1e-9, abs=1e-12)
        weights = {(r["sym"], r["state"]): r["weight"] for r in hmm.weights_of(sums, "sym").collect()}
        assert weights == pytest.approx({(r["sym"], r["state"]): r["weight"] for r in table_.collect()}, rel=1e-9)


def test_chains_of_many_distinct_columns_end_alike(spark, monkeypatch):
    """Without a number of rounds, with columns numbered in chunks or joined to their scores; nothing staged is left."""
    truth = model("((a:0.3,b:0.4):0.2,(c:0.25,d:0.5):0.2);")
    sim = programs.simulate(spark, truth, 600, 5, hmm.two_state(0.4, 60.0), (0.25, 1.0), block=300).cache()
    before = staged_paths()
    few = es.fit_conserved(sim, NAMES, truth, rho=0.6, coverage=0.2, length=20.0, size=128, tolerance=0.5)
    monkeypatch.setattr(lk, "MOST_TUPLES", 10)
    many = es.fit_conserved(sim, NAMES, truth, rho=0.6, coverage=0.2, length=20.0, size=128, tolerance=0.5)
    assert many.history == pytest.approx(few.history, rel=1e-6) and len(many.history) > 2
    assert many.chain.transition == pytest.approx(few.chain.transition, rel=1e-3) and many.models[0].scale == pytest.approx(few.models[0].scale, rel=1e-3)
    assert staged_paths() == before


def test_states_with_models_of_their_own(spark):
    slow, fast = model(scale=0.2), model("((a:0.5,b:0.1):0.1,(c:0.5,d:0.1):0.1);", kappa=8.0)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        m = (slow, fast)[i % 2]
        letters = np.array(list("ACGT"))[lk.simulate(m, 100, rng)]
        rows += [("s", i * 100 + k + 1, "".join(r)) for k, r in enumerate(letters)]
    columns = spark.createDataFrame(rows, "aln string, pos long, col string")
    start = [model("((a:0.1,b:0.1):0.1,(c:0.1,d:0.1):0.1);", scale=1.0), model("((a:0.4,b:0.4):0.1,(c:0.4,d:0.4):0.1);")]
    fit = es.fit_chain(columns, NAMES, start, hmm.two_state(0.5, 50.0), by=("aln",), rounds=8, size=512)
    assert min(np.diff(fit.history)) > -1e-6
    assert fit.models[1].tree.leaves()[0].length > 2 * fit.models[1].tree.leaves()[1].length
    assert fit.models[1].free[0] > fit.models[0].free[0]


def test_altered_branches_by_enumeration():
    m = es.alter(model("((a:0.3,b:0.5)x:0.4,c:0.7);"), ["b", "x"], selection=0.8, conversion=2.0)
    codes = np.array(list(product(range(4), repeat=3)))
    p = by_names(m)
    want = [p(c) for c in codes]
    assert np.exp(lk.column_loglik(m, codes)) == pytest.approx(want) and sum(want) == pytest.approx(1)
    assert lk._scaled(m, codes, np.ones(len(codes))) == pytest.approx(lk.column_loglik(m, codes))
    with pytest.raises(ValueError, match="no branch"):
        es.alter(m, ["nobody"])


def test_codon_bias():
    pi = np.full(64, 1 / 64)
    q = md.codon_model(pi, 2.0, 0.3)
    out = md.biased_codon(q, -1.0, 3.0)
    at = {c: i for i, c in enumerate(md.context_states(3))}
    ratio = lambda a, b: out[at[a], at[b]] / q[at[a], at[b]]
    assert ratio("GGA", "GGC") == pytest.approx(md.fixation(3)) and ratio("GGC", "GGA") == pytest.approx(md.fixation(-3))
    assert ratio("AAA", "GAA") == pytest.approx(md.fixation(2)) and ratio("AAA", "TAC") if q[at["AAA"], at["TAC"]] else True
    assert ratio("TTA", "TTT") == pytest.approx(md.fixation(-1)) and ratio("TAA", "TAG") == 1
    assert np.allclose(out.sum(1), 0) and md.fixation(0) == 1 and md.fixation(800) == 800 and md.fixation(-800) == pytest.approx(0)


@pytest.mark.parametrize("mode, n", [("none", 4), ("always", 4), ("mixed", 8)])
def test_site_classes_by_enumeration(mode, n):
    m = es.site_classes(model("((a:0.3,b:0.5)x:0.4,c:0.7);"), ["a"], (4.0, 2.0, 0.5), -2.0, 3.0, 1.5, mode)
    assert len(m.models) == n and m.weights.sum() == pytest.approx(1)
    assert m.weights[:2].sum() * (1.5 if mode == "mixed" else 1) == pytest.approx(6 / 7)
    codes = np.array(list(product(range(4), repeat=3)))[::3]
    want = [sum(w * by_names(x)(c) for x, w in zip(m.models, m.weights)) for c in codes]
    assert np.exp(es.loglik(m, codes)) == pytest.approx(want)
    null = es.site_classes(model("((a:0.3,b:0.5)x:0.4,c:0.7);"), ["a"], (4.0, 2.0, 0.5), -2.0, 3.0, 1.5, mode, alternative=False)
    same = es.site_classes(model("((a:0.3,b:0.5)x:0.4,c:0.7);"), ["a"], (4.0, 2.0, 0.5), -2.0, 0.0, 1.5, mode)
    assert es.loglik(null, codes) == pytest.approx(es.loglik(same, codes))


def test_site_classes_are_found(spark):
    truth = es.site_classes(model("((a:0.6,b:0.3)x:0.2,(c:0.3,d:0.4):0.1);"), ["a"], (1.0, 1.0), -3.0, 6.0)
    rng = np.random.default_rng(2)
    codes = np.concatenate([lk.simulate(x, int(round(20_000 * w)), rng) for x, w in zip(truth.models, truth.weights)])
    letters, n = np.unique(["".join("ACGT"[i] for i in r) for r in codes], return_counts=True)
    counts = table(spark, list(zip(letters.tolist(), n.tolist()))).cache()
    base = model("((a:0.6,b:0.3)x:0.2,(c:0.3,d:0.4):0.1);")
    found, value = es.fit_site_classes(counts, NAMES, base, ["a"])
    _, null = es.fit_site_classes(counts, NAMES, base, ["a"], alternative=False)
    assert value - null > 10 and found["positive"] > 2 and found["negative"] < -1 and found["scale"] == pytest.approx(1, abs=0.4)
    post = {r["tuple"]: r["posterior"] for r in es.class_posteriors(counts, NAMES, truth).collect()}
    assert all(sum(p) == pytest.approx(1) for p in post.values()) and post["CAAA"][2] + post["CAAA"][3] > post["AAAA"][2] + post["AAAA"][3]


def test_codon_tuples():
    tree = trees.number(trees.parse("(a:0.2,b:0.3);"))
    m = TreeModel(tree, md.codon_model(np.full(64, 1 / 64), 2.0, 0.5), np.full(64, 1 / 64))
    codes = es.codes_of(["AATTGG", "AC--GG", "CCCCCC"], ["a", "b"], m)
    assert codes.tolist() == [[0 * 16 + 3 * 4 + 2] * 2, [-1, -1], [21, 21]]
    assert np.isfinite(es.loglik(m, codes)).all()


# -- changes and scores of subtrees ------------------------------------------------------------------------------------


def jumps(m, inside, n, rng):
    """Simulated changes inside and outside, jump by jump."""
    out = np.zeros((n, 2), int)
    for k in range(n):
        rate = rng.choice(m.rates, p=m.weights)
        state = {m.tree.id: rng.choice(len(m.pi), p=m.pi)}
        for node in m.tree.preorder():
            if node.parent is not None:
                s, left = state[node.parent.id], node.length * m.scale * rate
                while (wait := rng.exponential(1 / -m.q[s, s])) < left:
                    left -= wait
                    p = np.maximum(m.q[s], 0)
                    s = rng.choice(len(p), p=p / p.sum())
                    out[k, 0 if node.id in inside else 1] += 1
                state[node.id] = s
    return out


def test_long_trees_keep_all_changes():
    from tessera.operators import substitutions as sb

    star = TreeModel(trees.number(trees.parse("(" + ",".join(f"l{i}:1.5" for i in range(80)) + ");")), md.hky85(PI, 3.0), PI)
    law = sb.site_counts(star)[0]
    assert law.sum() == pytest.approx(1, abs=1e-10) and law @ np.arange(len(law)) == pytest.approx(120, abs=1e-6)
    one = sb.branch_counts(star.q, 900.0)
    assert one.sum((0, 2)) == pytest.approx(np.ones(4), abs=1e-10) and (one.sum(2) * np.arange(len(one))[:, None]).sum(0) @ PI == pytest.approx(900, abs=1e-5)
    joint = sb.joint_counts(star, frozenset(n.id for n in star.tree.leaves()[:40]))
    assert joint.sum() == pytest.approx(1, abs=1e-9) and joint.sum(1) @ np.arange(len(joint)) == pytest.approx(60, abs=1e-5)


def test_joint_counts_match_simulation_and_condition():
    from tessera.functions import distributions as ds
    from tessera.operators import substitutions as sb

    m = model("((a:0.4,b:0.6)x:0.3,(c:0.5,d:0.3)y:0.2);", rates=np.array([0.5, 1.5]), weights=np.array([0.5, 0.5]))
    inside = lk.branches_below(m, "x", leading=True)
    prior = sb.joint_counts(m, inside)
    drawn_ = jumps(m, inside, 6000, np.random.default_rng(1))
    assert prior.sum() == pytest.approx(1)
    for a in range(4):
        for b in range(4):
            assert prior[a, b] == pytest.approx(((drawn_[:, 0] == a) & (drawn_[:, 1] == b)).mean(), abs=0.02)
    codes = np.array([[0, 1, 2, 2], [0, 0, 0, 0], [-1, 1, 1, -1]])
    joint = sb.joint_counts(m, inside, codes)
    assert np.log(joint.sum((1, 2))) == pytest.approx(lk.column_loglik(m, codes))
    whole = sb.site_counts(m, codes)
    for x, w in zip(joint, whole):
        t = ds.total_of(x)
        n = min(len(t), len(w))
        assert t[:n] == pytest.approx(w[:n], abs=1e-12)
    many = sb.joint_prior_alignment(m, inside, 40)
    assert many.sum(1) @ np.arange(len(many)) == pytest.approx(40 * (prior.sum(1) @ np.arange(len(prior))))


def test_subtree_counts_of_tuples_and_features(spark):
    from tessera.operators import substitutions as sb

    m = model("((a:0.4,b:0.6)x:0.3,(c:0.5,d:0.3)y:0.2);")
    d = spark.createDataFrame([("AAAA",), ("ACAA",), ("AAAC",), ("----",), ("ACAA",)], "tuple string")
    rows = {r["tuple"]: r for r in sb.test_subtrees(d, NAMES, m, "x").collect()}
    assert len(rows) == 4 and rows["ACAA"]["mean_in"] > 1 > rows["AAAA"]["mean_in"] and rows["AAAC"]["mean_out"] > rows["ACAA"]["mean_out"]
    assert rows["ACAA"]["p_acc_given"] < rows["AAAA"]["p_acc_given"] and all(0 <= rows["ACAA"][c] <= 1 for c in sb.SUBTREE_COLUMNS if c.startswith("p_"))
    prior = sb.joint_counts(m, lk.branches_below(m, "x"))
    assert rows["----"]["mean_in"] == pytest.approx(prior.sum(1) @ np.arange(len(prior)))
    feats = spark.createDataFrame([("f", "ACAA"), ("f", "ACAA"), ("g", "AAAA")], "name string, col string")
    out = {r["name"]: r for r in sb.test_features(feats, NAMES, m, ["name"], "x").collect()}
    assert out["f"]["n"] == 2 and out["f"]["mean_in"] == pytest.approx(2 * rows["ACAA"]["mean_in"]) and out["g"]["p_cons_in"] == pytest.approx(rows["AAAA"]["p_cons_in"])


def test_scores_of_subtrees(spark):
    m = model("((a:0.4,b:0.6)x:0.3,(c:0.5,d:0.3)y:0.2);")
    branches = lk.branches_below(m, "x")
    codes = lk.encode(["ACGT", "AAAA", "ACAA", "AACC", "A-CC", "----", "--AA"], NAMES, m.tree.leaf_names())
    found = lk.subtree_scores(m, codes, branches)
    for i in range(len(codes)):
        c, s = codes[i : i + 1], found["null_scale"][i]
        if i >= 5:
            assert (found["deriv"][i], found["stat"][i], found["p"][i]) == (0, 0, 1)
            continue
        at = lambda t, o: float(lk._scaled(m, c, np.array([t]), branches, np.array([t * o]))[0])  # noqa: B023, E731
        own = (at(s, 1.001) - at(s, 0.999)) / 0.002
        whole = (at(s * 1.001, 1.0) - at(s * 0.999, 1.0)) / 0.002
        grid = lk.subtree_information(m, branches, c[0] < 0, np.array([s]), draws=4000)[0]
        assert found["deriv"][i] == pytest.approx(own - grid[1] / grid[0] * whole, abs=0.05)
        assert found["stat"][i] == pytest.approx(found["deriv"][i] ** 2 / (grid[2] - grid[1] ** 2 / grid[0]), rel=0.35, abs=0.05)
    # the information agrees with the mean of second derivatives
    sim = lk.simulate(m, 4000, np.random.default_rng(7))
    one = np.ones(len(sim))
    second = lambda a, b: (lk._scaled(m, sim, one * np.exp(a), branches, one * np.exp(a + b)))
    h = 0.02
    own2 = -(second(0, h) - 2 * second(0, 0) + second(0, -h)).mean() / h**2
    cross = -(second(h, h) - second(h, -h) - second(-h, h) + second(-h, -h)).mean() / (4 * h * h)
    grid = lk.subtree_information(m, branches, np.zeros(4, bool), np.array([1.0]), draws=4000)[0]
    assert grid[2] == pytest.approx(own2, rel=0.15) and grid[1] == pytest.approx(cross, rel=0.15)
    # under the null large statistics are rare, under a fast subtree they are not
    null = lk.subtree_scores(m, lk.simulate(m, 600, np.random.default_rng(3)), branches)
    assert (null["p"].abs() < 0.05).mean() < 0.12
    n = np.full(len(sim), 1.0)
    fast = TreeModel(m.tree, m.q, m.pi, altered={i: m.q * 3 for i in branches})
    whole = lk.feature_tests(lk.simulate(fast, 300, np.random.default_rng(5)), n[:300], m, "SCORE", branches=branches)
    same = lk.feature_tests(lk.simulate(m, 300, np.random.default_rng(5)), n[:300], m, "SCORE", branches=branches)
    assert whole["stat"] > 15 and -1e-3 < whole["p"] < 0 and same["stat"] < 8
    d = spark.createDataFrame([("f", "ACAA"), ("f", "AAAA")], "name string, col string")
    assert lk.test_features(d, NAMES, m, ["name"], "SCORE", subtree="x").columns == ["name", "columns", "null_scale", "deriv", "stat", "p"]
    with pytest.raises(ValueError, match="LRT or SCORE"):
        lk.test_tuples(d.withColumnRenamed("col", "tuple"), NAMES, m, "GERP", subtree="x")


# -- queries without SQL, against other ways ---------------------------------------------------------------------------

DATA = "/root/testdata/sf0.001"


def rows_of(spark, name):
    from tessera.plans import registry

    registry.load()
    return [r.asDict() for r in registry.QUERIES[name](spark, DATA).collect()]


def test_em_query_reaches_the_direct_fit(spark):
    rounds = sorted(rows_of(spark, "fit_tree_em"), key=lambda r: r["round"])
    value = rows_of(spark, "fit_tree_model")[0]["loglik"]
    steps = np.diff([r["loglik"] for r in rounds])
    assert steps.min() > -1e-6 and value - 1.0 < rounds[-1]["loglik"] <= value + 1e-2


def test_parts_query_lies_between_one_fit_and_separate_ones(spark):
    from tessera.plans import tree_queries

    found = rows_of(spark, "fit_tree_parts")
    orders = spark.read.parquet(f"{DATA}/orders.parquet").selectExpr("o_orderkey aln", "o_orderpriority part")
    counts = tree_queries.alignment(spark, DATA).join(orders, "aln").groupBy("part", "col").count().toDF("part", "tuple", "cnt").cache()
    tree = trees.parse(tree_queries.TREE)
    _, together = es.fit_parts(counts, tree_queries.NAMES, tree, "HKY85", "part", shared=("branches", "rates"))
    _, apart = es.fit_parts(counts, tree_queries.NAMES, tree, "HKY85", "part", shared=())
    assert together - 1e-3 <= found[0]["loglik"] <= apart + 1e-2 and len(found) == orders.select("part").distinct().count()


def test_conserved_query_never_falls(spark):
    rounds = sorted(rows_of(spark, "fit_conserved_chain"), key=lambda r: r["round"])
    assert len(rounds) == 3 and np.diff([r["loglik"] for r in rounds]).min() > -1e-6 and 0 < rounds[-1]["rho"] < 1


def test_conserved_query_goes_on_until_a_round_gains_no_more(spark):
    """No number of rounds ends the fit: every round but the last gains at least the tolerance."""
    gains = np.diff([r["loglik"] for r in sorted(rows_of(spark, "fit_conserved_chain"), key=lambda r: r["round"])])
    assert -1e-6 < gains[-1] < 1e-2 and gains[:-1].min() >= 1e-2


def test_error_query_agrees_with_second_differences(spark):
    """Along one branch with all other numbers fixed the information is at least what the whole inverse leaves."""
    from tessera.plans import tree_queries

    found = {r["name"]: r for r in rows_of(spark, "tree_standard_errors")}
    counts = tree_queries.counts(spark, DATA)
    m, value = lk.fit(counts, tree_queries.NAMES, trees.parse(tree_queries.TREE), "HKY85")
    table_ = es.Table(counts, tree_queries.NAMES)
    parameters = es.Parameters(m.tree, "HKY85", {"": m.pi}, {"": 1}, rates=m.free)
    x = parameters.vector()
    for i, name in enumerate(parameters.names()):
        up, down = x.copy(), x.copy()
        up[i] += 0.01
        down[i] -= 0.01
        a, b, c = table_.logliks([parameters.models(v) for v in (down, x, up)])
        alone = np.exp(x[i]) / np.sqrt(-(a - 2 * b + c) / 1e-4)
        assert found[name]["value"] == pytest.approx(np.exp(x[i]), rel=1e-3) and found[name]["error"] > 0.95 * alone


# -- chains with tied transitions --------------------------------------------------------------------------------------


def test_chains_side_by_side(spark):
    truth = model("((a:0.4,b:0.5):0.3,(c:0.4,d:0.5):0.3);")
    outer, inner = hmm.two_state(0.3, 80.0), hmm.two_state(0.4, 25.0)
    strong = truth.with_(q=md.biased(truth.q, 0.0, 4.0))
    models = [strong.with_(scale=0.3), strong, truth.with_(scale=0.3), truth]  # biased first, and conserved first inside
    chain, rng, state, rows = hmm.cross_product(outer, inner), np.random.default_rng(6), 3, []
    states = []
    for _ in range(8000):
        state = int(rng.choice(4, p=chain.transition[state]))
        states.append(state)
    letters = np.array(list("ACGT"))
    cols = np.empty(8000, object)
    for s in range(4):
        at = np.flatnonzero(np.array(states) == s)
        cols[at] = ["".join(r) for r in letters[lk.simulate(models[s], len(at), rng)]]
    rows = [("x", i + 1, c) for i, c in enumerate(cols)]
    columns = spark.createDataFrame(rows, "aln string, pos long, col string").repartition(3)
    a, b, history = es.fit_biased_chain(columns, NAMES, models, hmm.two_state(0.5, 20.0), hmm.two_state(0.5, 60.0), rounds=15, size=1000)
    assert np.diff(history).min() > -1e-6
    assert 1 / a.transition[0, 1] == pytest.approx(80, rel=0.5) and 1 / b.transition[0, 1] == pytest.approx(25, rel=0.4)
    pairs = np.random.default_rng(1).random((4, 4))
    x, y = hmm.reestimated_product(outer, inner, pairs, np.ones(4))
    best = (pairs * np.log(hmm.cross_product(x, y).transition)).sum()
    for d in (0.01, -0.01):  # no near chain of this form is likelier
        t = x.transition + np.array([[d, -d], [0, 0]])
        assert (pairs * np.log(np.kron(t, y.transition))).sum() < best


def test_lineage_specific_elements(spark):
    truth = model("((a:0.5,b:0.6)x:0.3,(c:0.5,d:0.6)y:0.3);")
    states = es.lineage_states(truth, 0.1)
    assert list(states)[:2] == ["neutral", "conserved"] and len(states) == 2 + 2 * 6
    assert states["birth:x"][1] == {"a", "b"} and set(states["birth:x"][0].altered) | set(states["death:x"][0].altered) == {n.id for n in truth.tree.preorder() if n.parent}
    rng, rows, at = np.random.default_rng(8), [], 0
    letters = np.array(list("ACGT"))
    want = []
    for k in range(60):
        for name, n in (("neutral", 60), (("birth:x", "conserved", "birth:x")[k % 3], 30)):
            cols = letters[lk.simulate(states[name][0], n, rng)]
            rows += [("s", at + i + 1, "".join(r)) for i, r in enumerate(cols)]
            if name != "neutral":
                want.append((at + 1, at + n, name))
            at += n
    columns = spark.createDataFrame(rows, "aln string, pos long, col string").repartition(3)
    fit = es.fit_lineages(columns, NAMES, truth, rho=0.1, mu=0.2, nu=0.05, phi=0.2, rounds=8, size=500)
    assert np.diff(fit.history).min() > -1e-6 and fit.phi > 0.4
    assert 1 / fit.mu == pytest.approx(30, rel=0.4) and 1 / fit.nu == pytest.approx(60, rel=0.4)
    found = es.lineage_elements(columns, NAMES, truth, 0.1, fit, size=500).collect()
    hits = sum(any(r["state"] == name and r["start"] <= b and r["end"] >= a for r in found) for a, b, name in want)
    assert hits > 0.75 * len(want)
    # columns that are open in a lineage, or in all others, close its states
    d = spark.createDataFrame([("AA--",), ("--AA",), ("AAAA",), ("A---",)], "tuple string")
    place = list(states).index("birth:x")
    scores = {r["col"]: r["emission"][place] for r in es.lineage_scores(d, NAMES, truth, 0.1).collect()}
    assert scores["AAAA"] > -100 and {scores["AA--"], scores["--AA"], scores["A---"]} == {-1e4}
