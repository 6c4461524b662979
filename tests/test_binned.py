"""Column operators on one long key over many bins, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import binned, intervals, markov, tuples, windows

N = 6000


@pytest.fixture(autouse=True)
def narrow(monkeypatch):
    """Bins of 64 positions, so that the key's rows lie in a hundred bins."""
    for f in (binned.bin_of, binned.looking_back, intervals.runs_where, intervals.run_lengths, intervals.overlap_pairs):
        monkeypatch.setattr(f, "__defaults__", tuple(64 if d == intervals.BIN else d for d in f.__defaults__))


@pytest.fixture(scope="module")
def cols():
    rng = np.random.default_rng(1)
    chars = rng.choice(list("ACGT-*"), (N, 3), p=[0.2, 0.2, 0.1, 0.1, 0.3, 0.1])
    chars[500:700, 1:] = "*"
    chars[1000:1300, 2] = "-"
    chars[-3:, 1:] = "*"
    return ["".join(r) for r in chars]


@pytest.fixture(scope="module")
def columns(spark, cols):
    rows = [("x", i + 1, c) for i, c in enumerate(cols)] + [(None, i + 1, c) for i, c in enumerate(cols[:100])] + [("y", 7, "ACG")]
    return spark.createDataFrame(rows, "aln string, pos long, col string").repartition(5).cache()


def of(df, *fields):
    return sorted(tuple(r[f] for f in fields) for r in df.filter("aln = 'x'").collect())


def test_contexts(columns, cols):
    want = [(i + 1, "".join(cols[j] if j >= 0 else "***" for j in range(i - 2, i + 1))) for i in range(N)]
    assert of(tuples.contexts(columns, 3), "pos", "tuple") == want
    assert of(tuples.contexts(columns, 3, overlapping=False), "pos", "tuple") == want[2::3]
    assert tuples.contexts(columns, 2).filter("aln is null").count() == 100


def test_projection_and_coordinates(columns, cols):
    kept = [c for c in cols if c[2] != "-"]
    assert of(tuples.project(columns, 2), "pos", "col") == [(i + 1, c) for i, c in enumerate(kept)]
    at, want = 0, []
    for i, c in enumerate(cols):
        at += c[0] != "-"
        want.append((i + 1, at if c[0] != "-" else None))
    got = tuples.coordinate_map(columns, 0).filter("aln = 'x'").orderBy("pos").collect()
    assert [(r["pos"], r["seq_pos"]) for r in got] == want


def runs(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            out.append((start + 1, i))
            start = None
    return out


def test_runs(columns, cols):
    informative = [sum(ch not in "-*N" for ch in c) >= 2 for c in cols]
    assert of(tuples.informative_runs(columns), "start", "end") == runs(informative)
    missing = [all(ch in "*N" for ch in c[1:]) for c in cols]
    want = [(a, b) for a, b in runs(missing) if b - a + 1 >= 50 or b == N]
    assert of(tuples.missing_blocks(columns, 0, 50), "start", "end") == want and len(want) >= 2


def test_long_gaps(columns, cols):
    out = [list(c) for c in cols]
    for row in range(3):
        for a, b in runs([c[row] == "-" for c in cols]):
            if b - a + 1 > 4 and row != 1:
                for i in range(a - 1, b):
                    out[i][row] = "*"
    assert of(tuples.mask_long_gaps(columns, 3, 4, reference=1), "pos", "col") == [(i + 1, "".join(c)) for i, c in enumerate(out)]


def test_permutation_and_categories(columns, cols, spark):
    got = of(tuples.permute_columns(columns, 3), "pos", "col")
    assert [p for p, _ in got] == list(range(1, N + 1)) and sorted(c for _, c in got) == sorted(cols) and [c for _, c in got] != cols
    labels = spark.range(1, N + 1).select(F.lit("x").alias("aln"), F.col("id").alias("pos"), (F.col("id") % 3).cast("int").alias("cat"))
    split = of(tuples.split_by_category(columns, labels), "cat", "pos", "col")
    assert split == sorted((k, n + 1, c) for k in range(3) for n, c in enumerate(c for i, c in enumerate(cols) if (i + 1) % 3 == k))


def test_chains(spark, cols):
    rows = spark.createDataFrame([("x", i + 1, c[0]) for i, c in enumerate(cols)], "seq string, pos long, sym string").repartition(4)
    for order in (1, 3):
        want = {}
        for i in range(order, N):
            key = "|".join(c[0] for c in cols[i - order : i]), cols[i][0]
            want[key] = want.get(key, 0) + 1
        assert {(r["from"], r["to"]): r["cnt"] for r in markov.transitions(rows, order=order).collect()} == want
    counts = markov.transition_matrix(markov.transitions(rows))
    p = {(r["from"], r["to"]): r["p"] for r in counts.collect()}
    want = sum(np.log2(p[cols[i - 1][0], cols[i][0]]) for i in range(1, N))
    assert markov.path_loglik(rows, counts).first()["loglik"] == pytest.approx(want)


def test_sliding_and_sessions(spark):
    rng = np.random.default_rng(2)
    at, v = np.cumsum(rng.integers(1, 40, 3000)), rng.integers(0, 9, 3000)
    rows = spark.createDataFrame([("k", int(a), int(x)) for a, x in zip(at, v)], "key string, at long, v int").repartition(4)
    got = [(r["at"], r["value"]) for r in windows.sliding(rows, "at", 5, ["key"], "v").orderBy("at").collect()]
    assert got == [(int(a), int(v[i - 4 : i + 1].sum()) if i >= 4 else None) for i, a in enumerate(at)]
    found = sorted((r["start"], r["end"], r["n"]) for r in windows.sessions(rows, "at", 30, ["key"], [F.count(F.lit(1)).alias("n")]).collect())
    cuts = [0, *[i for i in range(1, 3000) if at[i] - at[i - 1] > 30], 3000]
    assert found == [(int(at[a]), int(at[b - 1]), b - a) for a, b in zip(cuts, cuts[1:])]


def test_no_window_over_a_whole_key(columns):
    """What is sorted by key alone are bins' own rows."""
    for df in (tuples.contexts(columns, 2), tuples.coordinate_map(columns, 0), tuples.project(columns, 0), tuples.permute_columns(columns, 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            if line.strip(" :+-").startswith("Window ["):
                assert "_b#" in line.split("windowspecdefinition(")[1].split("ASC")[0], line


def test_running_sums_meet_without_a_join(spark):
    rows = [(k, p, None if p % 5 == 0 else p) for k in ("x", None) for p in range(1, 40)]
    d = spark.createDataFrame(rows, "k string, pos long, v long")
    out = binned.running(d, ["k"], ["pos"], {"s": F.col("v"), "n": F.lit(1)}, binned.bin_of(d, "pos", 7))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["k"] or "", r["pos"], r["v"], r["s"], r["n"]) for r in out.collect())
    assert got == sorted((k or "", p, v, sum(q for q in range(1, p + 1) if q % 5), p) for k, p, v in rows)


def test_masking_looks_at_gaps_only(spark, monkeypatch):
    seen, real = [], intervals.runs_where

    def counted(rows, *more, **named):
        seen.append(rows.count())
        return real(rows, *more, **named)

    monkeypatch.setattr(intervals, "runs_where", counted)
    texts = ["AC-", "A--", "---", "A-C", "-GT", "-A-", "-A-", "TA-"]
    d = spark.createDataFrame([("x", i + 1, t) for i, t in enumerate(texts)], "aln string, pos long, col string")
    got = [r["col"] for r in tuples.mask_long_gaps(d, 3, 2, reference=0).orderBy("pos").collect()]
    assert got == ["AC*", "A**", "-**", "A*C", "-GT", "-A*", "-A*", "TA*"]
    assert seen == [sum(t[1:].count("-") for t in texts)]


def test_scores_of_few_columns_are_sent_to_all_tasks(spark):
    from tessera.operators import likelihood as lk

    d = spark.createDataFrame([("x", i, "AC"[i % 2]) for i in range(8)], "aln string, pos long, col string")
    scored = spark.createDataFrame([("A", 1.0), ("C", 2.0)], "col string, emission double")
    for most, way in ((2, "BroadcastHashJoin"), (1, "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            met = lk.with_scores(d, scored, scored, most)
            assert way in met._jdf.queryExecution().executedPlan().toString()
            assert sorted((r["pos"], r["emission"]) for r in met.collect()) == [(i, 1.0 + i % 2) for i in range(8)]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clusters_are_resolved_many_in_a_batch(spark):
    rows = [("x", g, 10 * g, 10 * g + w, s) for g, w, s in ((1, 12, 5.0), (2, 3, 4.0), (3, 11, 1.0), (4, 2, 3.0), (6, 2, None))]
    d = spark.createDataFrame(rows, "seqname string, grp long, start long, end long, score double")
    out = intervals.remove_overlaps(d)
    assert sorted(r["grp"] for r in out.collect()) == [1, 4, 6]
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
