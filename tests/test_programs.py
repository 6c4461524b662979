"""Whole analyses, gene checks, motifs, gaps, and readers and writers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions as ds
from tessera.functions import models as md
from tessera.operators import genes, hmm, indels, motifs, substitutions, trees
from tessera.operators import likelihood as lk
from tessera.plans import programs
from tessera.sources import alignments, features
from tessera.sources import models as files

TREE = "((a:0.1,b:0.2):0.05,(c:0.3,d:0.1):0.15);"
NAMES = list("abcd")


def model():
    pi = np.array([0.3, 0.2, 0.2, 0.3])
    return md.TreeModel(trees.parse(TREE), md.hky85(pi, 3.0), pi)


def test_substitution_counts():
    m = model()
    p = substitutions.site_counts(m)[0]
    assert p.sum() == pytest.approx(1) and ds.mean_var(p)[0] == pytest.approx(0.9)
    codes = lk.encode(["ACGT", "AAAA", "A-NC"], NAMES, m.tree.leaf_names())
    assert np.allclose(np.log(substitutions.site_counts(m, codes).sum(1)), lk.column_loglik(m, codes))
    inside = {n.id for n in m.tree.children[0].preorder()}
    joint = substitutions.joint_counts(m, inside)
    assert ds.joint_moments(joint)["mean_x"] == pytest.approx(0.35) and np.allclose(ds.total_of(joint)[: len(p)], p)
    assert substitutions.p_values(substitutions.prior_alignment(m, 50), 20)[0] < 1e-3


def test_simulation_and_tests(spark):
    m = model()
    chain = hmm.two_state(0.3, 60)
    d = programs.simulate(spark, m, 3000, 1, chain, (0.05, 2.0), block=1000).cache()
    assert d.count() == 3000 and sorted(d.toPandas()["pos"]) == list(range(1, 3001))
    again = programs.simulate(spark, m, 3000, 1, chain, (0.05, 2.0), block=1000)
    assert d.exceptAll(again).count() == 0
    sites = programs.site_tests(d, NAMES, m).groupBy("state").agg(F.avg("scale").alias("s")).orderBy("state").collect()
    assert sites[0]["s"] < sites[1]["s"]
    sph = programs.site_tests(d, NAMES, m, "SPH")
    assert sph.count() == 3000 and sph.filter("p_cons < 0 or p_cons > 1").count() == 0
    trained, value = programs.fit_conserved(d, NAMES, m.with_(scale=2.0), rho=0.025, rounds=5, size=500)
    assert trained.transition[0, 1] < 0.1 and np.isfinite(value)
    feats = spark.createDataFrame([("sim", 1, 500, "f1"), ("sim", 501, 3000, "f2")], "aln string, start long, end long, name string")
    out = {r["name"]: r["n"] for r in programs.feature_tests(d, feats, NAMES, m, ("name",)).collect()}
    assert out == {"f1": 500, "f2": 2500}
    for method, subtree in (("LRT", None), ("LRT", "1"), ("SCORE", None), ("GERP", None)):
        found = {r["name"]: r for r in programs.feature_tests(d.filter("pos <= 900"), feats, NAMES, m, ("name",), method, subtree=subtree).collect()}
        assert (found["f1"]["columns"], found["f2"]["columns"]) == (500, 400)
    below = programs.site_tests(d.filter("pos <= 300"), NAMES, m, subtree="1")
    assert below.count() == 300 and below.filter("alt_loglik < null_loglik - 1e-9").count() == 0
    w = programs.fit_windows(d, NAMES, m.tree, 1000, 1000).collect()
    assert len(w) == 3 and all(r["tree_length"] > 0 for r in w)
    rates = programs.rate_classes(d.filter("pos <= 200"), NAMES, md.TreeModel.gamma(m.tree, m.q, m.pi, 0.5, 3), size=64)
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in rates.collect())
    assert programs.biased_tracts(d.filter("pos <= 300"), NAMES, m, size=100).columns == ["aln", "start", "end", "n"]


def test_ancestors(spark):
    d = spark.createDataFrame([("x", 1, "AAAA"), ("x", 2, "AA--"), ("x", 3, "A-AA")], "aln string, pos long, col string")
    out = {(r["pos"], r["node"], r["base"]): r["p"] for r in programs.ancestral_bases(d, NAMES, model()).collect()}
    assert out[1, "a-c", "A"] > 0.9 and out[2, "c-d", "A"] == -1 and out[2, "a-c", "A"] == -1 and out[2, "a-b", "A"] > 0.9 and out[3, "a-b", "A"] > 0.9


def test_bootstrap_and_doctor(spark):
    d = programs.simulate(spark, model(), 2000, 2)
    out = programs.bootstrap(d, NAMES, trees.parse(TREE), rounds=3)
    assert out["a"]["min"] <= out["a"]["median"] <= out["a"]["max"]
    assert programs.tree_doctor(TREE, prune=["b"], rename={"a": "z"}, scale=2.0) == "(z:0.300000,(c:0.600000,d:0.200000):0.300000);"
    chain, names = programs.lineage_chain(trees.parse(TREE))
    assert np.allclose(chain.transition.sum(1), 1) and len(names) == 2 + 2 * 6
    assert programs.entropies(hmm.two_state(0.3, 45), lk.conserved_model(model()), model(), 2000)["entropy"] > 0


def test_bootstrap_draws_from_all_tuples(spark, monkeypatch):
    d = programs.simulate(spark, model(), 3000, 2).cache()
    distinct, seen = d.select("col").distinct().count(), []
    monkeypatch.setattr(lk, "MOST_TUPLES", 10)
    monkeypatch.setattr(lk, "fit", lambda table, *_: seen.append(table.agg(F.count("tuple"), F.sum("cnt")).first()) or (model(), 0.0))
    programs.bootstrap(d, NAMES, trees.parse(TREE), rounds=3)
    assert all(r[0] > distinct / 3 and abs(r[1] - 3000) < 300 for r in seen) and len({r[1] for r in seen}) > 1


def test_too_many_types_are_refused(spark):
    feats = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "at long, feature string")
    assert len(files.categories_from_features(feats, "at", most=4).ranges) == 4
    with pytest.raises(ValueError, match="more than 3"):
        files.categories_from_features(feats, "at", most=3)


def test_genes(spark):
    good = ["ATGAAACCCTAA", "ATGAAACCATAA"]
    assert genes.check_gene(good) == "ok"
    assert genes.check_gene(["ATGAAACCCTAA", "CTGAAACCATAA"]) == "bad_start"
    assert genes.check_gene(["ATGAAACCC"]) == "bad_stop"
    assert genes.check_gene(["ATGTAACCCTAA"]) == "nonsense"
    assert genes.check_gene(["ATGAAACCCTAA", "ATGA-ACCATAA"]) == "frameshift"
    assert genes.check_gene(["ATGAAACCCTAA", "ATG---CCATAA"]) == "ok"
    assert genes.check_gene(good, splice=[("GT", "AG"), ("CC", "AG")]) == "bad_intron"
    assert genes.check_gene([r.translate(str.maketrans("ACGT", "TGCA"))[::-1] for r in good], "-") == "ok"
    assert genes.codon_clean(["ATG-AAATAA", "ATGCTAACCC"]) == ["ATGAAANNN", "ATGNNNNNN"]
    assert genes.indel_clean(["ACGT-ACGTAC", "ACGTAACGTAC"], 1, 3, 1) == ["ACGN-NCGTAC", "ACGTAACGTAC"]
    assert genes.translate_rows(["ATG---TAA", "ATGNNNTAA"]) == ["M-*", "MX*"]
    d = spark.createDataFrame([("g1", good, "+"), ("g2", ["AAAAAATAA"], "+")], "g string, rows array<string>, strand string")
    assert dict(map(tuple, genes.clean_genes(d, ("g",)).collect())) == {"g1": "ok", "g2": "bad_start"}
    real = spark.createDataFrame([("c", 1, 10), ("c", 20, 30), ("c", 50, 60), ("c", 80, 90)], "seqname string, start long, end long")
    called = spark.createDataFrame([("c", 1, 10), ("c", 20, 33), ("c", 49, 61), ("c", 100, 110)], "seqname string, start long, end long")
    out = sorted((r["side"], r["start"], r["class"]) for r in genes.classify_exons(real, called).collect())
    assert out == [("called", 1, "correct"), ("called", 20, "partial"), ("called", 49, "overlapping"), ("called", 100, "wrong"), ("real", 1, "correct"), ("real", 20, "partial"), ("real", 50, "overlapping"), ("real", 80, "missed")]


def test_gaps(spark):
    t = trees.parse(TREE)
    assert indels.gap_pattern(t, "AC--", NAMES)[0] == "insertion" and indels.gap_pattern(t, "A-GT", NAMES)[0] == "deletion"
    assert indels.gap_pattern(t, "ACGT", NAMES) == ("null", -1) and indels.gap_pattern(t, "A--T", NAMES)[0] == "complex"
    cols = ["AAAA", "A-AA", "A-AA", "AAAA", "AA--", "AAAA"]
    d = spark.createDataFrame([("x", i + 1, c) for i, c in enumerate(cols)], "aln string, pos long, col string")
    runs = indels.history(d, NAMES, t)
    assert sorted((r["kind"], r["start"], r["end"]) for r in runs.collect()) == [("deletion", 2, 3), ("insertion", 5, 5)]
    rates = indels.branch_rates(runs, 6)
    assert len(rates) == 2 and np.isfinite(indels.log_likelihood([(n, "deletion", 2) for n in rates], rates, 6))


def test_motifs(spark):
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(60):
        s = list("".join(rng.choice(list("ACGT"), 40)))
        at = int(rng.integers(0, 32))
        s[at : at + 8] = "TTGACGCA"
        texts.append(("".join(s), at + 1))
    d = spark.createDataFrame(texts, "text string, planted int")
    bg = motifs.background(d)
    pwm, history = motifs.em(d, motifs.from_consensus("TTGACGAA", 0.6), bg, 10)
    assert history[-1] > history[0] and "".join("ACGT"[i] for i in pwm.argmax(1)) == "TTGACGCA"
    hit = motifs.predict(d, pwm, bg).collect()
    assert sum(r["start"] == r["planted"] for r in hit) >= 57
    codes = np.array([[0.9, 0.1], [0.1, 0.9]])
    v = spark.createDataFrame([([0.8, 0.2],), ([0.3, 0.7],)], "p array<double>")
    e = motifs.encode(v, "p", codes)
    assert [r["code"] for r in e.collect()] == [0, 1] and motifs.decode(e, codes).first()["vector"] == [0.9, 0.1]
    assert motifs.train_codes(v, "p", 2).shape == (2, 2)
    assert (files.unpack_codes(files.pack_codes(np.arange(300), 300), 300) == np.arange(300)).all()


# -- files -------------------------------------------------------------------------------------------------------------


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_feature_files(spark, tmp_path):
    gff = put(tmp_path, "a.gff", "##gff-version 2\nchr1\tsrc\texon\t5\t9\t.\t+\t.\tgene_id \"g\"\nchr1\tsrc\tCDS\t6\t8\t1.5\t-\t1\n")
    rows = sorted(map(tuple, features.read_features(spark, gff).collect()), key=lambda r: r[3])
    assert rows == [("chr1", "src", "exon", 5, 9, None, "+", None, 'gene_id "g"'), ("chr1", "src", "CDS", 6, 8, 1.5, "-", 2, ".")]
    lines = sorted(r["value"] for r in features.gff_lines(features.read_gff(spark, gff)).collect())
    assert lines == ["chr1\tsrc\tCDS\t6\t8\t1.5\t-\t1\t.", 'chr1\tsrc\texon\t5\t9\t.\t+\t.\tgene_id "g"']
    bed = put(tmp_path, "a.bed", "chr1 0 10\nchr1 50 100 n 5 -\nchr1 200 300 n 0 + 200 300 0 2 10,20, 0,80,\n".replace(" ", "\t"))
    got = sorted((r["start"], r["end"], r["attribute"]) for r in features.read_features(spark, bed).collect())
    assert got == [(1, 10, "."), (51, 100, 'id "n"'), (201, 210, 'id "n.2"'), (281, 300, 'id "n.2"')]
    back = [r["value"] for r in features.bed_lines(features.read_bed(spark, bed).withColumn("grp", F.regexp_extract("attribute", '"(.*)"', 1)).filter("grp = 'n.2'"), "grp").collect()]
    assert back == ["chr1\t200\t300\tn.2\t0\t+\t200\t300\t0\t2\t10,20\t0,80"]
    gp = put(tmp_path, "a.gp", "#name\nt1\tchr1\t+\t0\t100\t10\t90\t2\t0,50,\t30,100,\n")
    got = sorted((r["feature"], r["start"], r["end"], r["frame"]) for r in features.read_features(spark, gp).collect())
    assert got == [("CDS", 11, 30, 0), ("CDS", 51, 90, 2), ("exon", 1, 30, None), ("exon", 51, 100, None)]
    line = features.genepred_lines(features.read_genepred(spark, gp).withColumn("grp", F.lit("t1"))).first()["value"]
    assert line == "t1\tchr1\t+\t0\t100\t10\t90\t2\t0,50,\t30,100,"
    wig = put(tmp_path, "a.wig", "fixedStep chrom=c start=3 step=2\n1.0\n2.0\nvariableStep chrom=c span=2\n10 5.5\n")
    got = sorted((r["start"], r["end"], r["score"]) for r in features.read_features(spark, wig).collect())
    assert got == [(3, 3, 1.0), (5, 5, 2.0), (10, 11, 5.5)]
    w = spark.createDataFrame([("c", 1, 1, 0.5), ("c", 2, 2, 1.0), ("c", 9, 9, 2.0)], "seqname string, start long, end long, score double")
    assert "\n".join(r["value"] for r in features.wig_lines(w).collect()) == "fixedStep chrom=c start=1 step=1\n0.5000\n1.0000\nfixedStep chrom=c start=9 step=1\n2.0000"
    p = spark.createDataFrame([("chr2:5-9-",), ("bad",)], "t string").select(features.parse_position(F.col("t")).alias("p")).collect()
    assert tuple(p[0]["p"]) == ("chr2", 5, 9, "-") and p[1]["p"] is None


def test_alignment_files(spark, tmp_path):
    fa = put(tmp_path, "a.fa", "> one\nACGT\nAC\n>two\nAC-TNN\n")
    r = alignments.read_fasta(spark, fa)
    assert {x["seq"]: x["text"] for x in r.collect()} == {"one": "ACGTAC", "two": "AC-TNN"} and alignments.equal_lengths(r)
    assert sorted(x["value"] for x in alignments.fasta_lines(r, 4).collect()) == ["> one\nACGT\nAC", "> two\nAC-T\nNN"]
    assert alignments.to_long(r).count() == 12
    ph = put(tmp_path, "a.ph", "2 8\none ACGT\ntwo AC-T\nACGT\nACGA\n")
    assert {x["seq"]: x["text"] for x in alignments.read_phylip(spark, ph).collect()} == {"one": "ACGTACGT", "two": "AC-TACGA"}
    mpm = put(tmp_path, "a.mpm", "2 4\none\ntwo\nACGT\nAC-T\n")
    assert {x["seq"]: x["text"] for x in alignments.read_mpm(spark, mpm).collect()} == {"one": "ACGT", "two": "AC-T"}
    ss = put(tmp_path, "a.ss", "NSEQS = 2\nLENGTH = 7\nTUPLE_SIZE = 1\nNTUPLES = 2\nNAMES = x,y\nALPHABET = ACGT\nNCATS = -1\n\n0\tA-\t5\n1\tCC\t2\n")
    counts, head = alignments.read_counts(spark, ss)
    assert {x["tuple"]: x["cnt"] for x in counts.collect()} == {"A-": 5.0, "CC": 2.0} and head["NAMES"] == "x,y"
    text = [x["value"] for x in alignments.counts_lines(counts.select("tuple", "cnt"), ["x", "y"], 7).collect()]
    assert text[0].startswith("NSEQS = 2\nLENGTH = 7") and text[1:] == ["0\tA-\t5", "1\tCC\t2"]
    maf = put(tmp_path, "a.maf", "##maf version=1\n\na score=1\ns h.chr1 10 4 + 100 AC-GT\ns m.chr2 5 5 + 90 ACTGT\n\na score=2\ns h.chr1 20 2 + 100 AA\n")
    m = alignments.read_maf(spark, maf)
    got = sorted((x["pos"], x["col"]) for x in alignments.maf_columns(m, "h", ["h", "m"]).collect())
    assert got == [(11, "AA"), (12, "CC"), (13, "GG"), (14, "TT"), (21, "A*"), (22, "A*")]
    cut = sorted((x["seq"], x["start"], x["size"], x["text"]) for x in alignments.trim_maf(m, "h", 12, 13).collect())
    assert cut == [("h", 11, 2, "C-G"), ("m", 6, 3, "CTG")]
    assert alignments.maf_lines(m).count() == 2
    axt = put(tmp_path, "a.axt", "0 chr1 1 4 chr2 5 8 + 99\nACGT\nACGA\n\n1 chr1 9 9 chr2 9 9 - 5\nA\nA\n")
    assert sorted((x["block"], x["t_start"], x["q_text"]) for x in alignments.read_axt(spark, axt).collect()) == [(0, 1, "ACGA"), (1, 9, "A")]
    lav = put(tmp_path, "a.lav", "#:lav\nd {\n}\na {\n  s 1\n  b 1 1\n  l 1 5 10 14 90\n  l 12 16 20 24 80.5\n}\n")
    assert sorted((x["qs"], x["te"], x["identity"]) for x in alignments.read_lav(spark, lav).collect()) == [(1, 14, 90.0), (12, 24, 80.5)]
    assert [alignments.sniff(x) for x in (">a", "##maf version=1", "#:lav", "NSEQS = 3", "2 8")] == ["fasta", "maf", "lav", "ss", "phylip"]


def test_model_files():
    m = md.TreeModel.gamma(trees.parse(TREE), model().q, model().pi, 0.7, 4, kind="HKY85")
    back = files.parse_tree_model(files.tree_model_text(m, -12.5))
    assert np.allclose(back.q, m.q, atol=1e-5) and np.allclose(back.rates, m.rates) and trees.newick(back.tree) == trees.newick(m.tree) and back.kind == "HKY85"
    h = hmm.Hmm(np.array([[0.9, 0.1], [0.4, 0.6]]), np.array([0.5, 0.5]))
    again = files.parse_hmm(files.hmm_text(h))
    assert np.allclose(again.transition, h.transition) and np.allclose(again.begin, h.begin)
    named = files.parse_hmm("TRANSITION_MATRIX:\nA\tB\n 0.9 0.1\n 0.4 0.6\nEQUILIBRIUM_FREQUENCIES:\n0.8\n0.2\n")
    assert named.begin.tolist() == [0.8, 0.2]
    cm = files.parse_category_map("NCATS = 6\nCDS 1-3\nutr 4 { 1,2 }\nintron 5-6\nLABELLING_PRECEDENCE = 4,1,2,3\n")
    assert cm.category("CDS") == 1 and cm.category("none") == 0 and cm.categories(["CDS", "6"]) == [1, 2, 3, 6] and cm.feature(2) == "CDS" and cm.labelling == [4, 1, 2, 3]
    assert files.parse_category_map(files.category_map_text(cm)).ranges == cm.ranges
    path = [0, 1, 4, 4, 5, 2, 4]
    assert cm.spool(cm.unspool(path)) == path
    assert files.parse_pwm("0.7 0.1 0.1 0.1\n0.25 0.25 0.25 0.25\n")[0] == (0, "A", 0.7)
    assert files.parse_substitution_scores("  A C\nA 1 -2\nC -2 1\n")[("A", "C")] == -2.0


def test_block_operators(spark):
    rows = [(1, 1, "h.c1", "h", 10, 3, "+", 100, "A-CG"), (1, 2, "m.c2", "m", 5, 3, "+", 90, "A-CT"), (1, 3, "r.c3", "r", 0, 4, "+", 50, "ATCG")]
    maf = spark.createDataFrame(rows, "block long, k int, src string, seq string, start long, size long, strand string, src_size long, text string")
    two = alignments.sub_species(maf, ["r"], exclude=True)
    assert {r["seq"]: r["text"] for r in alignments.remove_gap_columns(two).collect()} == {"h": "ACG", "m": "ACT"}
    assert [r["seq"] for r in alignments.reorder_species(maf, ["m", "h"]).orderBy("k").collect()] == ["m", "h"]
    feats = spark.createDataFrame([("h.c1", 12, 20)], "seqname string, start long, end long")
    assert {r["seq"]: r["text"] for r in alignments.mask_regions(maf, feats, ["h"]).collect()} == {"h": "A-NN", "m": "A-CT", "r": "ATCG"}


def test_drawn_words(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (30, 40, 3, 50)] + ["ACGTACGTAC"] * 2
    seqs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    words = motifs.sample_ntuples(seqs, 5, 20, 1)
    assert len(words) == 20 and all(any(w in t for t in texts) and len(w) == 5 for w in words)
    assert words == motifs.sample_ntuples(seqs.repartition(3), 5, 20, 1) != motifs.sample_ntuples(seqs, 5, 20, 2)
    assert sorted(motifs.sample_ntuples(seqs, 5, 999, 1)) == sorted(t[i : i + 5] for t in texts for i in range(len(t) - 4))
    assert motifs.sample_ntuples(seqs.limit(0), 5, 9, 1) == []


def test_late_rows_and_chunks_of_a_stream(spark, tmp_path):
    """Four batches: rows behind the watermark of earlier batches go, others are counted once in their windows."""
    from tessera.streaming import streams

    schema = "ts timestamp, kind string"
    folder = str(tmp_path / "in")
    for batch in (["10:00:10", "10:00:50", "10:02:00"], ["10:09:30", "10:01:10"], ["10:09:40"], ["10:00:20", "10:20:00", "10:01:30"]):
        rows = spark.createDataFrame([(f"2024-01-01 {t}", "x") for t in batch], "ts string, kind string").select(F.col("ts").cast("timestamp"), "kind")
        rows.coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = streams.run_once(streams.windowed_counts(stream(), "ts", "1 minute", late="5 minutes"), str(tmp_path / "out"), "append", str(tmp_path / "state"))
    got = {r["start"].strftime("%H:%M"): r["n"] for r in out.collect()}
    assert got == {"10:00": 2, "10:01": 1, "10:02": 1, "10:09": 2}
    all_ = streams.run_once(streams.tuple_counts(stream(), "kind"), str(tmp_path / "all"), "complete", str(tmp_path / "state2"))
    assert [tuple(r) for r in all_.collect()] == [("x", 9)]
    none = streams.run_once(streams.tuple_counts(spark.readStream.schema(schema).parquet(str(tmp_path)), "kind"), str(tmp_path / "none"), "complete", str(tmp_path / "state3"))
    assert none.columns == ["tuple", "cnt"]
    with pytest.raises(ValueError):
        streams.run_once(stream(), str(tmp_path / "x"), "update", str(tmp_path / "y"))
