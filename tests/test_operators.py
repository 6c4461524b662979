"""Operators against plain versions on small cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions as ds
from tessera.functions import models as md
from tessera.functions import sequences as sq
from tessera.operators import hmm, intervals, markov, trees, tuples, windows
from tessera.operators import likelihood as lk

# -- intervals ---------------------------------------------------------------------------------------------------------


def random_feats(spark, n, seed, span=4000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randint(1, span)
        rows.append((i, rng.choice("xyz"), s, s + rng.choice([0, 1, 5, 80, 900]), float(rng.randint(1, 9)), rng.choice("+-"), None if rng.random() < 0.2 else rng.randint(0, 2), rng.choice("ab")))
    return rows, spark.createDataFrame(rows, "id long, seqname string, start long, end long, score double, strand string, frame int, feature string")


@pytest.mark.parametrize("width", [64, 1 << 17])
def test_overlaps(spark, width):
    a, da = random_feats(spark, 80, 1)
    b, db = random_feats(spark, 80, 2)
    pairs = [(x, y) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]]
    got = intervals.overlap_fragments(da, db, width=width).select("id", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted((x[0], max(x[2], y[2]), min(x[3], y[3])) for x, y in pairs)
    covered = {x[0]: len({p for w, y in pairs if w is x for p in range(max(x[2], y[2]), min(x[3], y[3]) + 1)}) for x in a}
    keep = {x[0] for x in a if covered[x[0]] >= 3 and covered[x[0]] >= 0.4 * (x[3] - x[2] + 1)}
    semi = intervals.overlap_semi(da, db, "id", min_bases=3, min_fraction=0.4, width=width)
    assert {r["id"] for r in semi.collect()} == keep
    anti = intervals.overlap_semi(da, db, "id", min_bases=3, min_fraction=0.4, anti=True, width=width)
    assert {r["id"] for r in anti.collect()} == {x[0] for x in a} - keep


def test_a_threshold_is_needed(spark):
    _, d = random_feats(spark, 3, 1)
    with pytest.raises(ValueError):
        intervals.overlap_fragments(d, d, min_bases=0, min_fraction=0.0)


@pytest.mark.parametrize("adjacent,width", [(True, 64), (False, 64), (True, 1 << 17)])
def test_merging(spark, adjacent, width):
    rows, d = random_feats(spark, 60, 3)
    want = []
    for name in "xyz":
        last = None
        for _, _, s, e, *_ in sorted((r for r in rows if r[1] == name), key=lambda r: (r[2], r[3])):
            if last and s <= last[1] + adjacent:
                last[1] = max(last[1], e)
            else:
                last = [s, e]
                want.append((name, last))
    got = intervals.merge_overlapping(d, adjacent=adjacent, width=width).collect()
    assert sorted(map(tuple, got)) == sorted((n, *x) for n, x in want)


def test_inverse(spark):
    rows, d = random_feats(spark, 25, 4)
    regions = [("x", 1, 2500), ("x", 3000, 9000), ("y", 1, 9000), ("w", 5, 10)]
    dr = spark.createDataFrame(regions, "seqname string, start long, end long")
    got = {(r["seqname"], p) for r in intervals.inverse(d, dr).collect() for p in range(r["start"], r["end"] + 1)}
    held = {(r[1], p) for r in rows for p in range(r[2], r[3] + 1)}
    assert got == {(n, p) for n, s, e in regions for p in range(s, e + 1)} - held


def test_greedy_choice(spark):
    rows = [("x", "g1", 1, 10, 5.0), ("x", "g2", 8, 20, 5.0), ("x", "g3", 15, 30, 9.0), ("x", "g4", 40, 50, 1.0), ("y", "g1", 1, 10, 1.0)]
    d = spark.createDataFrame(rows, "seqname string, grp string, start long, end long, score double")
    assert sorted((r["seqname"], r["grp"]) for r in intervals.remove_overlaps(d).collect()) == [("x", "g1"), ("x", "g3"), ("x", "g4"), ("y", "g1")]


def test_gene_parts(spark):
    rows = [("c", "g", "exon", 1, 100, "+"), ("c", "g", "exon", 201, 300, "+"), ("c", "g", "CDS", 51, 100, "+"), ("c", "g", "CDS", 201, 250, "+")]
    d = spark.createDataFrame(rows, "seqname string, grp string, feature string, start long, end long, strand string")
    by, exon, cds = ("seqname", "grp"), d.filter("feature = 'exon'"), d.filter("feature = 'CDS'")
    take = lambda x: sorted((r["feature"], r["start"], r["end"]) for r in x.collect())
    assert take(intervals.introns(exon, by)) == [("intron", 101, 200)]
    assert take(intervals.utrs(exon, cds, by)) == [("3'UTR", 251, 300), ("5'UTR", 1, 50)]
    assert take(intervals.signals(cds, by)) == [("3'splice", 199, 200), ("5'splice", 101, 102), ("start_codon", 51, 53), ("stop_codon", 248, 250)]
    codons = spark.createDataFrame([("c", "g", "start_codon", 48, 50, "+"), ("c", "g", "stop_codon", 248, 250, "+")], d.schema)
    assert take(intervals.fix_start_stop(cds.unionByName(codons), by).filter("feature = 'CDS'")) == [("CDS", 48, 100), ("CDS", 201, 247)]
    helper = spark.createDataFrame([("c", "g", "prestart", 45, 50, "+")], d.schema)
    assert take(intervals.absorb_helpers(cds.unionByName(helper), ["CDS"], ["prestart"], by).filter("feature = 'CDS'")) == [("CDS", 45, 100), ("CDS", 201, 250)]


def test_asof(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, t int")
    marks = spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0), ("b", 2, 3.0)], "k string, m int, v double")
    assert sorted(map(tuple, intervals.asof_position(rows, marks, ("k",), "t", "m", ("v",)).collect())) == [("a", 5, 1.0), ("a", 10, 2.0), ("b", 1, None)]
    strict = intervals.asof_position(rows, marks, ("k",), "t", "m", ("v",), strict=True)
    assert sorted((r["k"], r["t"], r["v"]) for r in strict.collect()) == [("a", 5, None), ("a", 10, 2.0), ("b", 1, None)]


# -- tuples ------------------------------------------------------------------------------------------------------------


def columns(spark, cols, aln="a"):
    return spark.createDataFrame([(aln, i + 1, c) for i, c in enumerate(cols)], "aln string, pos long, col string")


def test_tuples(spark):
    d = columns(spark, ["AC-", "AC-", "NNN", "*C*", "GGG", "---"])
    counts = tuples.tuple_counts(tuples.contexts(d, 1))
    assert {r["tuple"]: r["cnt"] for r in counts.collect()} == {"AC-": 2, "NNN": 1, "*C*": 1, "GGG": 1, "---": 1}
    assert {r["tuple"]: r["cnt"] for r in tuples.collapse_missing(counts, gaps_too=True).collect()} == {"AC*": 2, "***": 2, "*C*": 1, "GGG": 1}
    assert [r["pos"] for r in tuples.strip_gaps(d, "any").orderBy("pos").collect()] == [3, 4, 5]
    assert [r["pos"] for r in tuples.strip_gaps(d, "all").orderBy("pos").collect()] == [1, 2, 3, 4, 5]
    p = {(r["a"], r["b"]): (r["compared"], r["differing"], r["p"]) for r in tuples.pairwise_difference(counts, 3).collect()}
    assert p == {(0, 1): (3, 2, pytest.approx(2 / 3)), (0, 2): (1, 0, 0.0), (1, 2): (1, 0, 0.0)}
    assert tuples.expand(counts).count() == 6
    assert {r["base"]: r["cnt"] for r in tuples.base_counts(d).collect()} == {"A": 2, "C": 3, "G": 3}


def test_contexts(spark):
    d = columns(spark, ["AB", "CD", "EF", "GH"])
    assert [r["tuple"] for r in tuples.contexts(d, 2).orderBy("pos").collect()] == ["**AB", "ABCD", "CDEF", "EFGH"]
    assert [r["tuple"] for r in tuples.contexts(d, 2, overlapping=False).orderBy("pos").collect()] == ["ABCD", "EFGH"]


def test_fourfold(spark):
    d = spark.createDataFrame([("CCTTAG",), ("C*TTAG",), ("CATTAG",), ("CCAAAG",), ("GGGGA-",), ("AACCTT",)], "t string")
    assert [r[0] for r in d.select(tuples.fourfold_degenerate(F.col("t"), 2)).collect()] == [True, True, False, False, False, True]


# -- sequences ---------------------------------------------------------------------------------------------------------


def test_strings(spark):
    d = spark.createDataFrame([("ATGGCCTAA",)], "s string")
    s = F.col("s")
    row = d.select(sq.translate_codons(s).alias("aa"), sq.reverse_complement(s).alias("rc"), sq.reverse_complement_segment(s, 2, 4).alias("seg"), sq.gc_content(s).alias("gc"), sq.kmer_code(F.lit("ACGT"), 4).alias("code"), sq.kmer_of(F.lit(27), 4).alias("kmer"), sq.kmer_code(F.lit("AN"), 2).alias("bad")).first()
    assert row["aa"] == "MA*" and row["rc"] == "TTAGGCCAT" and row["seg"] == "ACCAGCCTAA"[:1] + "CCA" + "CCTAA"
    assert row["gc"] == pytest.approx(4 / 9) and row["code"] == 27 and row["kmer"] == "ACGT" and row["bad"] == -1
    t = spark.createDataFrame([(" a.b.c ", 'x "y z" w', "p/q.txt")], "a string, b string, c string")
    r = t.select(sq.trim_both(F.col("a")), sq.root(sq.trim_both(F.col("a"))), sq.shortest_root(sq.trim_both(F.col("a"))), sq.suffix(sq.trim_both(F.col("a"))), sq.split_quoted(F.col("b")), sq.basename(F.col("c")), sq.as_int(F.lit("12")), sq.as_int(F.lit("x"))).first()
    assert tuple(r) == ("a.b.c", "a.b", "a", "c", ["x", '"y z"', "w"], "q.txt", 12, None)


# -- windows and chains ------------------------------------------------------------------------------------------------


def test_hopping(spark):
    d = spark.createDataFrame([("a", i) for i in range(1, 24)], "k string, pos int")
    got = {(r["start"], r["end"]): r["n"] for r in windows.hopping(d, "pos", 10, 4, ["k"], [F.count(F.lit(1)).alias("n")]).collect()}
    assert got == {(s, s + 9): min(23, s + 9) - s + 1 for s in range(1, 24, 4)}


def test_markov(spark):
    d = spark.createDataFrame([("q", i, c) for i, c in enumerate("ABABB")], "seq string, pos int, sym string")
    m = markov.transition_matrix(markov.transitions(d))
    assert {(r["from"], r["to"]): r["p"] for r in m.collect()} == {("A", "B"): 1.0, ("B", "A"): 0.5, ("B", "B"): 0.5}
    assert markov.path_loglik(d, m).first()["loglik"] == -2.0
    smooth = markov.transition_matrix(markov.transitions(d), 1.0, ["A", "B"])
    assert {(r["from"], r["to"]): r["p"] for r in smooth.collect()}[("A", "A")] == pytest.approx(0.25)


def hmm_case(n=37, states=3, seed=1):
    rng = np.random.default_rng(seed)
    model = hmm.Hmm(rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states)))
    return model, np.log2(rng.random((n, states)) + 0.05)


def test_hmm_by_enumeration():
    model, e = hmm_case(6, 2)
    paths = [np.array(p) for p in itertools.product(range(2), repeat=6)]
    scores = [hmm.path_score(model, e, p) for p in paths]
    total = math.log2(sum(2.0**s for s in scores))
    assert hmm.logsum(hmm.forward(model, e)[-1] + model.logs()[2], 0) == pytest.approx(total)
    path, score = hmm.viterbi(model, e)
    assert score == pytest.approx(max(scores)) and hmm.path_score(model, e, path) == pytest.approx(score)
    post = hmm.posteriors(hmm.forward(model, e), hmm.backward(model, e))
    want = sum(2.0 ** (s - total) for s, p in zip(scores, paths) if p[3] == 1)
    assert post[3, 1] == pytest.approx(want)


@pytest.mark.parametrize("size", [5, 8, 4096])
def test_hmm_in_chunks(spark, size):
    cases = {k: hmm_case(n, seed=n)[1] for k, n in (("a", 37), ("b", 5), ("c", 1), ("d", 16))}
    model = hmm_case()[0]
    rows = spark.createDataFrame([(k, i + 1, row.tolist()) for k, e in cases.items() for i, row in enumerate(e)], "seq string, pos long, emission array<double>")
    lik = {r["seq"]: r["loglik"] for r in hmm.log_likelihood(rows, model, size=size).collect()}
    post, path, score = {}, {}, {}
    for r in hmm.posterior(rows, model, size=size).collect():
        post.setdefault(r["seq"], {})[r["pos"]] = r["posterior"]
    for r in hmm.best_path(rows, model, size=size).collect():
        path.setdefault(r["seq"], {})[r["pos"]] = r["state"]
        score[r["seq"]] = r["score"]
    for k, e in cases.items():
        f, b = hmm.forward(model, e), hmm.backward(model, e)
        assert lik[k] == pytest.approx(float(hmm.logsum(f[-1] + model.logs()[2], 0)))
        assert np.allclose([post[k][i + 1] for i in range(len(e))], hmm.posteriors(f, b))
        want, best = hmm.viterbi(model, e)
        assert score[k] == pytest.approx(best) and [path[k][i + 1] for i in range(len(e))] == want.tolist()


def test_training_raises_the_likelihood(spark):
    model, e = hmm_case(120, 2)
    model = hmm.Hmm(model.transition, model.begin)
    rows = spark.createDataFrame([("a", i + 1, x.tolist()) for i, x in enumerate(e)], "seq string, pos long, emission array<double>")
    trained, history = hmm.train(rows, model, rounds=4, size=50)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    assert np.allclose(trained.transition.sum(1), 1)


# -- distributions -----------------------------------------------------------------------------------------------------


def test_tails():
    assert ds.chisq_cdf(3.841458820694124, 1) == pytest.approx(0.95)
    assert ds.chisq_cdf(100, 1, lower=False) == pytest.approx(1.5239706048320995e-23)
    assert ds.half_chisq_cdf(0, 1, lower=False) == 1.0
    assert ds.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert ds.poisson_cdf(3, 2.5) == pytest.approx(sum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(4)))
    assert ds.discrete_gamma(0.5, 4).mean() == pytest.approx(1)


def test_convolutions():
    p = np.array([0.2, 0.5, 0.3])
    assert np.allclose(ds.convolve(p, 3), np.convolve(np.convolve(p, p), p))
    j = np.outer(p, p)
    assert np.allclose(ds.total_of(j), np.convolve(p, p)) and np.allclose(ds.convolve2(j, j), np.outer(np.convolve(p, p), np.convolve(p, p)))
    assert ds.p_value(p, 0) == pytest.approx(0.2) and ds.p_value(p, 2, "upper") == pytest.approx(0.3) and ds.p_value(p, 1, "both") == 1.0
    assert ds.interval(p, 0.5) == (1, 2)


# -- trees and likelihoods ---------------------------------------------------------------------------------------------

TREE = "((a:0.1,b:0.2):0.05,(c:0.3,d:0.1):0.15);"


def test_trees():
    t = trees.name_ancestors(trees.parse(TREE))
    assert trees.newick(trees.parse(trees.newick(t))) == trees.newick(t)
    assert t.distances()[("a", "c")] == pytest.approx(0.6) and t.total_length() == pytest.approx(0.9)
    assert trees.lca([t.find("c"), t.find("d")]).name == "c-d"
    pruned, gone = trees.prune(t, ["b"])
    assert gone == ["b"] and pruned.distances()[("a", "c")] == pytest.approx(0.6)
    for name in ("a", "c-d", "d"):
        r = trees.reroot(t, name, 0.3)
        want = t.distances()
        got = r.distances()
        assert {frozenset(k): pytest.approx(v) for k, v in want.items()} == {frozenset(k): v for k, v in got.items()}
    m = trees.midpoint(t)
    assert m.children[0].leaves()[0].depth() > 0 and max(x.depth() for x in m.leaves()) == pytest.approx(max(t.distances().values()) / 2)
    assert len(list(trees.topologies(list("abcd")))) == 15
    assert trees.parsimony(t, {"a": "A", "b": "C", "c": "C", "d": "C"})[0] == 1
    assert len(trees.parse("(a:1,b:1,c:1);").leaves()) == 3 and all(len(n.children) in (0, 2) for n in trees.parse("(a:1,b:1,c:1);").preorder())


def plain_likelihood(model, states):
    inner = [n for n in model.tree.preorder() if n.children]
    total = 0.0
    for k, w in enumerate(model.weights):
        for values in itertools.product(range(4), repeat=len(inner)):
            of = {n.id: v for n, v in zip(inner, values)}
            p = model.pi[of[model.tree.id]]
            for n in model.tree.preorder():
                if n.parent is not None:
                    row = md.expm_squaring(model.q * n.length * model.rates[k])[of[n.parent.id]]
                    p *= row[of[n.id]] if n.children else (1.0 if states[n.name] < 0 else row[states[n.name]])
            total += w * p
    return math.log(total)


def gamma_model():
    pi = np.array([0.3, 0.2, 0.2, 0.3])
    return md.TreeModel.gamma(trees.parse(TREE), md.gc_model(pi, 3.0, 1.5), pi, 0.7, 3)


def test_likelihood_by_enumeration():
    model = gamma_model()
    for col in ("ACGT", "AAAA", "A-NC", "----"):
        codes = lk.encode([col], list("abcd"), model.tree.leaf_names())
        want = plain_likelihood(model, dict(zip(model.tree.leaf_names(), codes[0])))
        assert lk.column_loglik(model, codes)[0] == pytest.approx(want)
        assert lk._scaled(model, codes, np.ones(1))[0] == pytest.approx(want)
    post = lk.ancestral_posteriors(model, lk.encode(["ACGT"], list("abcd"), model.tree.leaf_names()))
    assert all(p.sum() == pytest.approx(1) for p in post.values())


def test_models():
    pi = np.array([0.1, 0.2, 0.3, 0.4])
    for q in (md.f81(pi), md.hky85(pi, 2.0), md.reversible(pi, np.arange(1, 7.0)), md.unrestricted(pi, np.arange(1, 13.0))):
        assert np.allclose(q.sum(1), 0) and -(pi * np.diag(q)).sum() == pytest.approx(1)
        assert np.allclose(md.expm(q, 0.7)[0], md.expm_squaring(q * 0.7))
    assert md.is_reversible(md.hky85(pi, 2.0), pi) and not md.is_reversible(md.unrestricted(pi, np.arange(1, 13.0)), pi)
    k = 2
    pi2 = np.full(16, 1 / 16)
    n = max(md.context_classes(k, True).values()) + 1
    assert np.allclose(md.context_reversible(pi2, k, np.ones(n), True).sum(1), 0)
    codon = md.codon_model(np.full(64, 1 / 64), 2.0, 0.3)
    assert np.allclose(md.amino_rates(codon, np.full(64, 1 / 64))[0].sum(1), 0)


def test_fit_recovers_a_model(spark):
    true = md.TreeModel(trees.parse(TREE), md.hky85(np.array([0.3, 0.2, 0.2, 0.3]), 3.0), np.array([0.3, 0.2, 0.2, 0.3]))
    codes = lk.simulate(true, 20_000, np.random.default_rng(1))
    cols = ["".join("ACGT"[x] for x in row) for row in codes]
    d = tuples.tuple_counts(columns(spark, cols).withColumn("tuple", F.col("col")))
    fitted, value = lk.fit(d, list("abcd"), trees.parse("((a:0.2,b:0.2):0.1,(c:0.2,d:0.2):0.1);"), "HKY85")
    assert value >= lk.total_loglik(d, list("abcd"), true) - 1e-6
    assert fitted.tree.total_length() == pytest.approx(0.9, rel=0.06)
    assert value == pytest.approx(lk.total_loglik(d, list("abcd"), fitted))


def test_site_tests():
    model = gamma_model()
    codes = lk.encode(["AAAA", "ACGT", "A---", "CTGA"], list("abcd"), model.tree.leaf_names())
    t = lk.scale_tests(model, codes)
    assert t["p"][0] > 0 > t["p"][1] and t["scale"][0] < 1 < t["scale"][1] and t["scale"][2] == 1 and t["p"][2] == 1
    assert (lk.scale_tests(model, codes, "CON")["lr"] >= 0).all()
    g = lk.rejected_substitutions(model, codes)
    assert g["neutral"][0] == pytest.approx(0.9) and g["rejected"][0] > 0 and g["neutral"][2] == 0
    s = lk.score_tests(model, codes)
    assert s["deriv"][0] < 0 < s["deriv"][1]


def test_subtree_tests():
    m = gamma_model()
    below = lk.branches_below(m, str(m.tree.children[0].id))
    assert below == {n.id for n in m.tree.children[0].children} and lk.branches_below(m, "a") == {next(n.id for n in m.tree.leaves() if n.name == "a")}
    with pytest.raises(ValueError):
        lk.branches_below(m, "nobody")
    codes = lk.encode(["AAAA", "ACGG", "AAGC", "--GC", "A-A-"], list("abcd"), m.tree.leaf_names())
    t = lk.subtree_tests(m, codes, below)
    grid = np.exp(np.linspace(-7, np.log(20), 81))
    for i, c in enumerate(codes[:3]):
        at = lambda s, u: float(lk._scaled(m, c[None], np.array([s]), below, np.array([u]))[0])  # noqa: B023, E731
        assert t["null_loglik"][i] >= max(at(s, s) for s in grid) - 1e-6
        assert t["alt_loglik"][i] >= max(at(s, u) for s in grid for u in grid) - 2e-3
        assert t["alt_loglik"][i] == pytest.approx(at(t["scale"][i], t["scale"][i] * t["subtree_scale"][i]), abs=1e-4)
    assert t["subtree_scale"][1] > 1 > t["subtree_scale"][2] and t["p"][1] < 0 < t["p"][2]
    assert t["p"][3] == 1 and t["subtree_scale"][3] == 1
    assert (lk.subtree_tests(m, codes, below, "CON")["subtree_scale"] <= 1).all()


@pytest.mark.parametrize("method", ["LRT", "SCORE", "GERP"])
def test_feature_tests(method):
    m = gamma_model()
    codes = lk.encode(["AAAA", "ACGT", "AAGG", "A---"], list("abcd"), m.tree.leaf_names())
    one = lk.feature_tests(codes[1:2], np.ones(1), m, method)
    alone = {"LRT": lk.scale_tests, "SCORE": lk.score_tests}.get(method)
    want = alone(m, codes[1:2]) if alone else lk.rejected_substitutions(m, codes[1:2])
    assert all(one[c] == pytest.approx(want[c][0], abs=1e-5) for c in one)
    n = np.array([30.0, 2.0, 5.0, 9.0])
    both = lk.feature_tests(codes, n, m, method)
    if method == "LRT":
        value = lambda s: float(lk._scaled(m, codes, np.full(4, s)) @ n)
        assert both["alt_loglik"] == pytest.approx(max(value(s) for s in np.linspace(0.01, 3, 600)), abs=1e-3)
        assert both["scale"] < 1 and both["p"] > 0
        sub = lk.feature_tests(codes, n, m, branches=lk.branches_below(m, "a"))
        assert sub["alt_loglik"] >= sub["null_loglik"] == pytest.approx(both["alt_loglik"])
    elif method == "SCORE":
        each, info = lk._scores(m, codes)
        assert both["stat"] == pytest.approx((each[:3] @ n[:3]) ** 2 / (info[:3] @ n[:3]))
    else:
        assert both["neutral"] == pytest.approx((lk.rejected_substitutions(m, codes)["neutral"] * n).sum())


def test_optimisers():
    x, v = lk.bfgs(lambda p: (p[0] - 1) ** 2 + 10 * (p[1] + 2) ** 2 + p[0] * p[1], np.zeros(2))
    a = np.linalg.solve(np.array([[2.0, 1.0], [1.0, 20.0]]), np.array([2.0, -40.0]))
    assert np.allclose(x, a, atol=1e-4)
    x, _ = lk.bfgs(lambda p: ((p - 3) ** 2).sum(), np.zeros(2), high=np.array([1.0, 9.0]))
    assert np.allclose(x, [1, 3], atol=1e-4)
    assert lk.brent(lambda z: (z - 0.3) ** 2, 0, 1)[0] == pytest.approx(0.3)


def test_conserved_elements(spark):
    model = md.TreeModel(trees.parse(TREE), md.hky85(np.full(4, 0.25), 2.0), np.full(4, 0.25))
    rng = np.random.default_rng(3)
    codes = np.concatenate([lk.simulate(m, n, rng) for m, n in ((model.with_(scale=3.0), 300), (model.with_(scale=0.05), 120), (model.with_(scale=3.0), 300))])
    d = columns(spark, ["".join("ACGT"[x] for x in row) for row in codes])
    post, elements = lk.conserved_posteriors(d, list("abcd"), model.with_(scale=3.0), rho=0.05, coverage=0.2, length=60, size=100)
    p = np.array([r["posterior"] for r in post.orderBy("pos").collect()])
    assert p[320:400].mean() > 0.9 and p[:280].mean() < 0.2
    found = elements.collect()
    assert len(found) == 1 and abs(found[0]["start"] - 301) < 15 and abs(found[0]["end"] - 420) < 15 and found[0]["score"] > 0


# -- further column operators ------------------------------------------------------------------------------------------


def test_more_column_operators(spark):
    d = columns(spark, ["A--", "A--", "A-C", "ANN", "A*N", "ACC"])
    assert [r["pos"] for r in tuples.strip_missing(d, 0).orderBy("pos").collect()] == [1, 2, 3, 6]
    masked = [r["col"] for r in tuples.mask_long_gaps(d, 3, 2, reference=0).orderBy("pos").collect()]
    assert masked == ["A*-", "A*-", "A*C", "ANN", "A*N", "ACC"]
    assert [r["col"] for r in tuples.missing_to_gaps(d).orderBy("pos").collect()][3:5] == ["A--", "A--"]
    counts = tuples.tuple_counts(tuples.contexts(d, 2))
    assert sum(r["cnt"] for r in tuples.shorten_context(counts, 3, 1).collect()) == 6
    feats = spark.createDataFrame([("a", 2, 3, 7), ("a", 6, 9, 8)], "aln string, start long, end long, id int")
    assert sorted((r["id"], r["pos"], r["col"]) for r in tuples.extract_features(d, feats).collect()) == [(7, 1, "A--"), (7, 2, "A-C"), (8, 1, "ACC")]
    assert tuple(tuples.sequence_lengths(d, 3).first())[1:] == (6, 3, 4)
    mapping = tuples.coordinate_map(d, 2)
    moved = tuples.map_features(spark.createDataFrame([("a", 1, 2, 1), ("a", 4, 9, 2), ("a", 8, 9, 3)], feats.schema), mapping)
    assert sorted(map(tuple, moved.select("id", "start", "end").collect())) == [(1, 3, 4), (2, 6, 6)]
    labels = spark.createDataFrame([("a", 2, 1), ("a", 5, 1)], "aln string, pos long, cat int")
    assert sorted((r["cat"], r["pos"]) for r in tuples.split_by_category(d, labels).collect()) == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (1, 2)]
    at = spark.createDataFrame([(i, b, 1) for i in range(3) for b in "ACGT"], "at int, base string, cnt long")
    freqs = tuples.codon_frequencies(at).collect()
    assert len(freqs) == 61 and sum(r["freq"] for r in freqs) == pytest.approx(1)


@pytest.mark.parametrize("width", [4, 1 << 17])
def test_runs_over_bins(spark, width):
    rng = random.Random(5)
    rows = [("k", p, rng.choice([1.0, 2.0, 3.0]), rng.choice("ab")) for p in sorted(rng.sample(range(1, 90), 60))]
    d = spark.createDataFrame(rows, "k string, p long, v double, s string")
    for step in (1, None):
        want, last = [], None
        for i, (_, p, v, _) in enumerate(rows):
            if v <= 1:
                last = None
                continue
            if last is None or (step is not None and p - rows[i - 1][1] > step):
                last = [p, p, 0, 0.0]
                want.append(last)
            last[1:] = [p, last[2] + 1, last[3] + v]
        got = intervals.threshold_runs(d, ("k",), "p", "v", 1.0, step, width).select("start", "end", "n", "score").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    want = [(k, g[0][1], g[-1][1], len(g)) for k, g in ((k, list(g)) for k, g in itertools.groupby(rows, key=lambda r: r[3]))]
    got = intervals.run_lengths(d, ("k",), "p", "s", width).select("s", "start", "end", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    marks = spark.createDataFrame([("k", p, float(p)) for p in (5, 6, 40, 77)], "k string, m long, w double")
    got = intervals.asof_position(d, marks, ("k",), "p", "m", ("w",), bins=lambda c: F.floor(c / width)).collect()
    assert {r["p"]: r["w"] for r in got} == {p: max((float(m) for m in (5, 6, 40, 77) if m <= p), default=None) for _, p, _, _ in rows}


@pytest.mark.parametrize("depth", [64, 65, 150])
def test_closure_of_deep_trees(spark, depth):
    edges = spark.createDataFrame([(str(i), str(i - 1), 1.0) for i in range(1, depth + 1)], "node string, parent string, len double")
    out = {(int(r["node"]), int(r["ancestor"])): (r["dist"], r["length"]) for r in trees.closure(edges).collect()}
    assert out == {(i, j): (i - j, float(i - j)) for i in range(depth + 1) for j in range(i + 1)}


@pytest.mark.parametrize("cycle", [1, 3])
def test_closure_refuses_cycles(spark, cycle):
    edges = spark.createDataFrame([(str(i), str((i + 1) % cycle), 1.0) for i in range(cycle)], "node string, parent string, len double")
    with pytest.raises(ValueError, match="cycle"):
        trees.closure(edges)
