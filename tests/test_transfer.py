"""Positions and features through alignments, against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import transfer
from tessera.sources import alignments


def test_features_through_segments(spark):
    segs = [("q", 1, 10, 19, 110, 119), ("q", 1, 30, 39, 125, 134), ("q", 2, 100, 149, 500, 549), ("z", 3, 1, 9, 1, 9)]
    segments = spark.createDataFrame(segs, "seqname string, block int, qs long, qe long, ts long, te long")
    spans = [(1, "q", 5, 12), (2, "q", 15, 35), (3, "q", 22, 27), (4, "q", 1, 200), (5, "z", 4, 4), (6, "y", 1, 50), (7, "q", 19, 30)]
    feats = spark.createDataFrame(spans, "id int, seqname string, start long, end long")
    got = sorted((r["id"], r["block"], r["start"], r["end"]) for r in transfer.transfer_features(feats, segments, "id", width=16).collect())
    assert got == [(1, 1, 110, 112), (2, 1, 115, 130), (4, 1, 110, 134), (4, 2, 500, 549), (5, 3, 4, 4), (7, 1, 119, 125)]


def test_positions_through_segments(spark):
    segs = [(10, 19, 110, 119), (30, 39, 125, 134), (50, 59, 90, 99)]
    segments = spark.createDataFrame([("q", 1, *s) for s in segs], "seqname string, block int, qs long, qe long, ts long, te long")
    points = spark.createDataFrame([("q", p) for p in (1, 10, 15, 22, 39, 45, 55, 70)], "seqname string, p long")
    for right, want in ((False, [None, 110, 115, 119, 134, None, 95, 99]), (True, [110, 110, 115, 125, 134, None, 95, None])):
        for bins in (None, lambda at: F.floor(at / 16)):
            got = sorted((r["p"], r["target"]) for r in transfer.target_positions(points, segments, "p", right=right, bins=bins).collect())
            assert [t for _, t in got] == want


def test_shuffled_blocks_read_as_sorted_ones(spark, tmp_path):
    rng = random.Random(3)
    line = lambda src, start, text: f"s {src} {start} {len(text.replace('-', ''))} + 1000 {text}"
    blocks, at = [], 0
    for _ in range(12):
        ref, other = "".join(rng.choice("ACGT-") for _ in range(9)) + "A", "".join(rng.choice("ACGT-") for _ in range(10))
        blocks.append("a score=0\n" + line("r.c", at, ref) + "\n" + line("s.c", at, other))
        at += len(ref.replace("-", "")) + rng.randint(0, 2)
    texts = {"sorted": blocks, "shuffled": rng.sample(blocks, len(blocks))}
    found = {}
    for name, bs in texts.items():
        (tmp_path / f"{name}.maf").write_text("##maf version=1\n\n" + "\n\n".join(bs) + "\n")
        maf = alignments.read_maf(spark, str(tmp_path / f"{name}.maf"))
        found[name] = sorted((r["pos"], r["col"]) for r in transfer.unsorted_columns(maf, "r", ["r", "s"]).collect())
    plain = sorted((r["pos"], r["col"]) for r in alignments.maf_columns(alignments.read_maf(spark, str(tmp_path / "sorted.maf")), "r", ["r", "s"]).collect())
    assert found["sorted"] == found["shuffled"] == plain


def test_the_first_of_overlapping_blocks_wins(spark):
    rows = [(2, 1, "r.c", "r", 0, 4, "+", 99, "ACGT"), (2, 2, "s.c", "s", 0, 4, "+", 99, "AAAA"), (1, 1, "r.c", "r", 2, 4, "+", 99, "G-TAA"), (1, 2, "s.c", "s", 0, 5, "+", 99, "CCCCC")]
    maf = spark.createDataFrame(rows, "block long, k int, src string, seq string, start long, size long, strand string, src_size long, text string")
    got = sorted((r["pos"], r["col"]) for r in transfer.unsorted_columns(maf, "r", ["r", "s"]).collect())
    assert got == [(1, "AA"), (2, "CA"), (3, "GC"), (4, "TC"), (5, "AC"), (6, "AC")]


def test_blocks_cut_to_features(spark):
    rows = [(1, 1, "r.c", "r", 10, 6, "+", 99, "AC--GTAC"), (1, 2, "s.c", "s", 5, 7, "+", 99, "ACGTA-TT")]
    maf = spark.createDataFrame(rows, "block long, k int, src string, seq string, start long, size long, strand string, src_size long, text string")
    feats = spark.createDataFrame([("f", "r.c", 12, 14), ("g", "r.c", 1, 11), ("h", "r.c", 40, 50), ("i", "r.c", 16, 16)], "name string, seqname string, start long, end long")
    got = {(r["name"], r["seq"]): (r["start"], r["size"], r["text"]) for r in transfer.cut_blocks(maf, "r", feats, "name", width=8).collect()}
    assert got == {("f", "r"): (11, 3, "C--GT"), ("f", "s"): (6, 4, "CGTA-"), ("g", "r"): (10, 1, "A"), ("g", "s"): (5, 1, "A"), ("i", "r"): (15, 1, "C"), ("i", "s"): (11, 1, "T")}


def test_records_of_odd_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text("; a remark\nACGT\n>one first\nAC GT\nac\n\n> two\r\nGG\r\nTT\r\n>empty\n>three\nA>C\n")
    (tmp_path / "b.fa").write_text(">four\n" + "ACGT" * 30_000 + "\nN\n")
    got = sorted((r["seq"], r["text"]) for r in alignments.read_fasta(spark, str(tmp_path)).collect())
    assert got == [("four", "ACGT" * 30_000 + "N"), ("one", "ACGTac"), ("three", "A>C"), ("two", "GGTT")]
    order = [r["seq"] for r in alignments.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()]
    assert order == ["one", "two", "three"]


def test_runs_of_a_simulated_chain_cross_blocks(spark):
    import numpy as np

    from tessera.functions import models as md
    from tessera.functions.models import TreeModel
    from tessera.operators import hmm, trees
    from tessera.plans import programs

    pi = np.full(4, 0.25)
    m = TreeModel(trees.number(trees.parse("(a:0.1,b:0.1);")), md.jc69()[0], pi)
    chain = hmm.two_state(0.4, 50.0)
    states = [r["state"] for r in programs.simulate(spark, m, 40_000, 3, chain, (0.3, 1.0), block=16).orderBy("pos").collect()]
    steps = np.zeros((2, 2))
    borders = np.zeros((2, 2))
    for i, (a, b) in enumerate(zip(states, states[1:])):
        steps[a, b] += 1
        borders[a, b] += (i + 1) % 16 == 0
    for x in (steps, borders):
        assert np.allclose(x / x.sum(1, keepdims=True), chain.transition, atol=0.02)
    assert abs(np.mean(np.array(states) == 0) - 0.4) < 0.08


def test_unsorted_blocks_are_neither_broadcast_nor_met_by_character(spark):
    from tessera.plans import registry

    plan = registry.QUERIES["unsorted_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_columns_of_blocks_with_gaps_and_absent_rows(spark):
    rows = [(1, 1, "r.c", "r", 0, 3, "+", 99, "a-CG"), (1, 2, "s.c", "s", 0, 3, "+", 99, "AC-"), (2, 1, "s.c", "s", 0, 2, "+", 99, "AC"), (3, 1, "r.c", "r", 7, 2, "+", 99, "-TT"), (3, 2, "t.c", "t", 0, 2, "+", 99, "GGG")]
    maf = spark.createDataFrame(rows, "block long, k int, src string, seq string, start long, size long, strand string, src_size long, text string")
    of = lambda **more: sorted(tuple(r) for r in alignments.maf_columns(maf, "r", ["s", "r"], **more).select("block", "at", "pos", "col").collect())
    bases = [(1, 0, 1, "AA"), (1, 2, 2, "-C"), (1, 3, 3, "*G"), (3, 1, 8, "*T"), (3, 2, 9, "*T")]
    assert of() == bases
    assert of(drop_reference_gaps=False) == sorted([*bases, (1, 1, 1, "C-"), (3, 0, 7, "*-")])
