"""Every registered query with SQL against a second engine on the smallest tables, and every other one for its rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def second():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, second, name):
    df = registry.QUERIES[name](spark, DATA)
    found = second.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_name_is_registered_once():
    with pytest.raises(ValueError):
        registry.query("interval_inverse")(lambda spark, d: None)


# -- queries without SQL, against plain versions -----------------------------------------------------------------------


def rows_of(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, DATA).collect()]


def test_unique_groups_equal_plain_ones(spark, second):
    from tessera.plans.views import FEATS

    feats = second.execute(f"WITH {FEATS} SELECT event_id, seqname, event_id // 3 AS grp, start, \"end\", score FROM feats").fetchall()
    spans = {}
    for _, seq, grp, start, end, score in feats:
        a, b, s = spans.get((seq, grp), (start, end, 0.0))
        spans[seq, grp] = min(a, start), max(b, end), s + score
    kept = {}
    for (seq, grp), (start, end, score) in sorted(spans.items(), key=lambda x: (x[0][0], x[1][0], x[1][1], x[0][1])):
        held = kept.setdefault(seq, {})
        hit = [g for g, (a, b, _) in held.items() if a <= end and start <= b]
        if not hit or score > sum(held[g][2] for g in hit):
            for g in hit:
                del held[g]
            held[grp] = start, end, score
    want = sorted((i, seq, grp) for i, seq, grp, *_ in feats if grp in kept[seq])
    assert sorted((r["event_id"], r["seqname"], r["grp"]) for r in rows_of(spark, "unique_groups")) == want


def test_likelihood_ratios_equal_plain_ones(spark, second):
    per = second.execute("SELECT user_id, count(*), count(*) FILTER (WHERE event_type = 'purchase') FROM events GROUP BY 1").fetchall()
    p0 = sum(k for *_, k in per) / sum(n for _, n, _ in per)
    xlog = lambda x, p: x * math.log(p) if x else 0.0
    want = {}
    for user, n, k in per:
        lr = max(2 * (xlog(k, k / n) + xlog(n - k, 1 - k / n) - xlog(k, p0) - xlog(n - k, 1 - p0)), 0.0)
        want[user] = lr, math.erfc(math.sqrt(lr / 2))
    got = {r["user_id"]: (r["lr"], r["p"]) for r in rows_of(spark, "lrt_pvalue")}
    assert got.keys() == want.keys()
    assert all(got[u] == pytest.approx(want[u], abs=2e-6) for u in want)


def test_trained_chain_equals_a_plain_one(spark):
    """Three rounds of expectation-maximisation with scaled chances, sequence by sequence."""
    from tessera.plans import sequence_queries

    found = {}
    for r in sequence_queries.emissions(spark, DATA).collect():
        found.setdefault(r["seq"], {})[r["pos"]] = [2.0**x for x in r["emission"]]
    seqs = [[e for _, e in sorted(x.items())] for x in found.values()]
    t, begin = sequence_queries.CHAIN.transition.tolist(), sequence_queries.CHAIN.begin.tolist()
    for _ in range(3):
        steps, begins, total = [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0], 0.0
        for e in seqs:
            f, scale = [], []
            for i, x in enumerate(e):
                v = [begin[s] * x[s] if i == 0 else sum(f[-1][q] * t[q][s] for q in (0, 1)) * x[s] for s in (0, 1)]
                scale.append(sum(v))
                f.append([y / scale[-1] for y in v])
            b = [[1.0, 1.0]]
            for i in range(len(e) - 1, 0, -1):
                b.insert(0, [sum(t[s][q] * e[i][q] * b[0][q] for q in (0, 1)) / scale[i] for s in (0, 1)])
            total += sum(map(math.log2, scale))
            for s in (0, 1):
                begins[s] += f[0][s] * b[0][s]
                for q in (0, 1):
                    steps[s][q] += sum(f[i][s] * t[s][q] * e[i + 1][q] * b[i + 1][q] / scale[i + 1] for i in range(len(e) - 1))
        t, begin = [[x / sum(r) for x in r] for r in steps], [x / sum(begins) for x in begins]
    got = rows_of(spark, "baum_welch")
    assert all(r["p"] == pytest.approx(t[r["from"]][r["to"]], abs=1e-5) and r["loglik"] == pytest.approx(total, abs=0.01) for r in got)


def plain_tree_loglik(column, scale, rates):
    """The column's log-likelihood on the queries' tree, branches times a scale, by sums over all inner states."""
    pi = dict(zip("ACGT", (0.3, 0.2, 0.2, 0.3)))

    def chance(i, j, length, rate):
        if j == "-":
            return 1.0
        x = math.exp(-length * scale * rate / 1.22)
        alike = {i, j} in ({"A", "G"}, {"C", "T"}, {i})
        return pi[j] * (1 - x) + (2 * pi[j] * (x - x * x) if alike else 0.0) + (x * x if i == j else 0.0)

    a, b, c, d = column
    total = 0.0
    for rate in rates:
        for root in "ACGT":
            left = sum(chance(root, i, 0.05, rate) * chance(i, a, 0.1, rate) * chance(i, b, 0.2, rate) for i in "ACGT")
            right = sum(chance(root, i, 0.15, rate) * chance(i, c, 0.3, rate) * chance(i, d, 0.1, rate) for i in "ACGT")
            total += pi[root] * left * right / len(rates)
    return math.log(total) if total > 0 else -math.inf


def test_site_tests_equal_plain_ones(spark):
    from tessera.plans import tree_queries

    rates = tree_queries.model().rates.tolist()
    lrt = {r["tuple"]: r for r in rows_of(spark, "site_tests_lrt")}
    score = {r["tuple"]: r for r in rows_of(spark, "site_tests_score")}
    gerp = {r["tuple"]: r for r in rows_of(spark, "site_tests_gerp")}
    assert lrt.keys() == score.keys() == gerp.keys()
    grid = [20 * (i / 400) ** 3 for i in range(401)]
    for column in sorted(lrt):
        null = plain_tree_loglik(column, 1.0, rates)
        best = max(null, max(plain_tree_loglik(column, s, rates) for s in grid))
        r = lrt[column]
        assert r["null_loglik"] == pytest.approx(null, abs=2e-5) and best - 2e-5 <= r["alt_loglik"] <= best + 2e-3
        assert r["lr"] == pytest.approx(2 * (r["alt_loglik"] - r["null_loglik"]), abs=5e-5)
        assert plain_tree_loglik(column, r["scale"], rates) == pytest.approx(r["alt_loglik"], abs=2e-4)
        slope = (plain_tree_loglik(column, 1.001, rates) - plain_tree_loglik(column, 0.999, rates)) / 0.002
        assert score[column]["deriv"] == pytest.approx(slope, abs=1e-4)
        neutral = 0.9 - (0.1 if column[3] == "-" else 0.0)
        assert gerp[column]["neutral"] == pytest.approx(neutral)
        assert gerp[column]["observed"] == pytest.approx(neutral * r["scale"], abs=1e-3)


def test_leading_bits_of_many_digests():
    import hashlib

    import numpy as np

    from tessera.functions.digests import md5_leading

    tails = [b"", b":0", b":17", b":199"]
    for length in (1, 3, 4, 7, 19, 51):
        heads = [f"{i:0{length}d}"[-length:].encode() for i in range(0, 900, 7)]
        got = md5_leading(np.frombuffer(b"".join(heads), np.uint8).reshape(-1, length), tails)
        assert got.tolist() == [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for h in heads] for t in tails]
    with pytest.raises(ValueError):
        md5_leading(np.zeros((1, 53), np.uint8), [b":10"])


def test_bootstrap_makes_no_row_for_each_draw(spark, monkeypatch):
    seen, kind = [], type(spark.range(1))
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(self._jdf.queryExecution().executedPlan().toString()) or real(self))
    registry.QUERIES["bootstrap"](spark, DATA)
    assert seen and all("Generate" not in p for p in seen)


def test_kmer_counts_equal_codes_of_each_text(spark):
    from pyspark.sql import functions as F

    from tessera.functions import sequences as sq

    texts = ["ACGTACGTNNACGT", "", None, "AC", "ACG", "é\U0001f600ACGTTé", "ACGT" * 500_000, "TTTT", "A\U0001f600CGTA"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for k in (1, 3, 4):
        plain = {r["code"]: r["count"] for r in d.select(F.explode(sq.kmer_codes(F.col("t"), k)).alias("code")).groupBy("code").count().collect()}
        for most in (1 << 20, 2):
            assert {r["code"]: r["n"] for r in sq.kmer_counts(d, F.col("t"), k, most=most).collect()} == plain
    assert "Generate" not in registry.QUERIES["kmer_codes"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_dealt_once_before_they_become_rows(spark, monkeypatch, tmp_path):
    from tessera.plans import format_queries as fq

    # orders out of order, one of many lines, line numbers used twice, only gaps
    lines = [(n * 7 % 41, i % 5 + 1, i, 1, 45.0 if n == 3 else 3.0 * (i % 16), "ANR"[i % 3], "FO"[i % 2]) for n in range(41) for i in range(400 if n == 9 else n % 6 + 1)]
    d = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string")
    more = d.selectExpr("*", "1.5D l_extendedprice", "timestamp'2020-01-01 00:00:00' l_shipdate", "0D l_discount", "0D l_tax")
    more.repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    plans, written = [], []

    def write(s, frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        written.append(_write(s, frame))
        return written[-1]

    _write = fq._written
    monkeypatch.setattr(fq, "_written", write)
    for name in ("maf_round_trip", "fasta_round_trip"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        found = con.execute(registry.ORACLES[name])
        names = [c[0] for c in found.description]
        assert plain(df.collect(), df.columns) == plain(found.fetchall(), names)
        assert plans[-1].count("Exchange ") == 1 and "Window" not in plans[-1]
    assert "rangepartitioning" in plans[0]
    texts = [open(f).read() for f in sorted(glob.glob(f"{written[0].removeprefix('file://')}/part-*"))]
    starts = [int(line.split()[2]) for t in texts for line in t.split("\n") if line.startswith("s s0.")]
    assert len(starts) == 41 and starts == sorted(starts)
