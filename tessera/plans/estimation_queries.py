"""Queries on expected changes, re-estimation, joint fits, and positions carried through alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import models as md
from tessera.operators import estimation as es
from tessera.operators import categories, hmm, transfer, trees
from tessera.operators import likelihood as lk
from tessera.plans import registry, sequence_queries, tree_queries, views
from tessera.plans.registry import query
from tessera.plans.tree_queries import LIKELIHOOD, NAMES
from tessera.plans.views import FEATS, SYMBOLS
from tessera.runtime import table

# -- expected changes --------------------------------------------------------------------------------------------------

_LEAVES = {"a": ("ab", "b", "up_cd", 1, 2), "b": ("ab", "a", "up_cd", 2, 1), "c": ("cd", "d", "up_ab", 3, 4), "d": ("cd", "c", "up_ab", 4, 3)}


def _outside(branch: str, other: str) -> str:
    """What is known of the node below a branch of the root from everything but its own subtree."""
    return f"SELECT o.tuple, o.rate, p.j AS i, sum(pi * p.p * o.p) AS p FROM {other} o JOIN p ON p.branch = '{branch}' AND p.rate = o.rate AND p.i = o.i JOIN bases ON x = o.i GROUP BY ALL"


def _leaf_changes(leaf: str) -> str:
    top, sister, _, own, its = _LEAVES[leaf]
    return f"""SELECT o.tuple, '{leaf}' AS branch, p.i AS above, p.j AS below, sum(o.p * s.p * p.p) AS p FROM out_{top} o JOIN leaf s ON s.branch = '{sister}' AND s.rate = o.rate AND s.i = o.i AND s.c = substr(o.tuple, {its}, 1)
JOIN p ON p.branch = '{leaf}' AND p.rate = o.rate AND p.i = o.i AND substr(o.tuple, {own}, 1) IN (p.j, '-') GROUP BY ALL"""


def _top_changes(branch: str, other: str) -> str:
    return f"""SELECT h.tuple, '{branch}' AS branch, p.i AS above, p.j AS below, sum(pi * p.p * h.p * o.p) AS p FROM {branch} h JOIN p ON p.branch = '{branch}' AND p.rate = h.rate AND p.j = h.i
JOIN {other} o ON o.tuple = h.tuple AND o.rate = h.rate AND o.i = p.i JOIN bases ON x = p.i GROUP BY ALL"""


CHANGES = f"""{LIKELIHOOD}, out_ab AS ({_outside("ab", "up_cd")}), out_cd AS ({_outside("cd", "up_ab")}),
joint AS ({" UNION ALL ".join([*map(_leaf_changes, "abcd"), _top_changes("ab", "up_cd"), _top_changes("cd", "up_ab")])})"""


@query("tree_expected_changes", f"WITH {CHANGES} SELECT branch, above, below, round(sum(cnt * joint.p / whole.p), 5) AS n FROM joint JOIN tuples USING (tuple) JOIN whole USING (tuple) GROUP BY ALL")
def tree_expected_changes(spark, d):
    """For each branch, how often each base is expected to become each other one, over all columns."""
    m = tree_queries.model()
    found, _ = es.Table(tree_queries.counts(spark, d), NAMES).changes({"": m})
    labels = {n.id: n.name or "".join(leaf.name for leaf in n.leaves()) if n.children else n.name for n in m.tree.preorder()}
    rows = [(labels[node], a, b, round(float(x.sum(0)[i, j]), 5)) for node, x in found[""].items() for i, a in enumerate(md.DNA) for j, b in enumerate(md.DNA)]
    return spark.createDataFrame(rows, "branch string, above string, below string, n double")


@query("fit_tree_em")
def fit_tree_em(spark, d):
    """The tree and kappa by expectation-maximisation, with the log-likelihood of every round."""
    models, history = es.fit_em(tree_queries.counts(spark, d), NAMES, trees.parse(tree_queries.TREE), "HKY85", rounds=40)
    m = models[""]
    return spark.createDataFrame([(i, float(v), trees.newick(m.tree, 4), float(m.free[0])) for i, v in enumerate(history)], "round int, loglik double, tree string, kappa double")


@query("fit_tree_parts")
def fit_tree_parts(spark, d):
    """One tree for the orders of all priorities, each with a scale and a kappa of its own."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("aln"), F.col("o_orderpriority").alias("part"))
    counts = tree_queries.alignment(spark, d).join(orders, "aln").groupBy("part", F.col("col").alias("tuple")).agg(F.count(F.lit(1)).alias("cnt"))
    parts = [r["part"] for r in orders.select("part").distinct().orderBy("part").limit(50).collect()]
    models, value = es.fit_parts(counts, NAMES, trees.parse(tree_queries.TREE), "HKY85", "part", shared=("branches",), scaled=tuple(parts[1:]))
    return spark.createDataFrame([(p, float(m.scale), float(m.free[0]), trees.newick(m.tree, 4), value) for p, m in models.items()], "part string, scale double, kappa double, tree string, loglik double")


@query("tree_standard_errors")
def tree_standard_errors(spark, d):
    counts = tree_queries.counts(spark, d)
    fitted, _ = lk.fit(counts, NAMES, trees.parse(tree_queries.TREE), "HKY85")
    return spark.createDataFrame(es.standard_errors(counts, NAMES, fitted), "name string, value double, error double")


@query("subtree_score_tests")
def subtree_score_tests(spark, d):
    return lk.test_tuples(tree_queries.counts(spark, d), NAMES, tree_queries.model(), "SCORE", subtree="1")


# -- chains ------------------------------------------------------------------------------------------------------------


@query("chain_state_weights", f"""WITH RECURSIVE {SYMBOLS}, e AS (SELECT seq, pos, {sequence_queries.EMISSION_SQL} AS e FROM symbols),
{sequence_queries.both_ways("""SELECT sym, state, round(sum(CASE WHEN state = 0 THEN p ELSE 1 - p END), 4) AS weight FROM (SELECT seq, pos, 1 / (1 + pow(2, f.b + g.b - f.a - g.a)) AS p FROM f JOIN g USING (seq, pos)) JOIN symbols USING (seq, pos), (VALUES (0), (1)) s(state) GROUP BY sym, state""")}""")
def chain_state_weights(spark, d):
    """How much of each symbol the posterior gives to each state: what re-estimating the states' models starts from."""
    rows = sequence_queries.emissions(spark, d).join(views.symbols(spark, d), ["seq", "pos"])
    return hmm.expected_tables(rows, sequence_queries.CHAIN, "sym", size=64)[3].select("sym", "state", F.round("weight", 4).alias("weight"))


@query("predicted_features", registry.ORACLES["hmm_viterbi"].removesuffix("SELECT seq, pos, state, score FROM t") + """, i AS (SELECT seq, pos, state, pos - row_number() OVER (PARTITION BY seq, state ORDER BY pos) AS run FROM t)
SELECT seq, min(pos) AS start, max(pos) AS "end", count(*) AS n, 'busy' AS feature, '+' AS strand FROM i WHERE state = 1 GROUP BY seq, run""")
def predicted_features(spark, d):
    """Runs of the second state on the best path of every user, as features."""
    path = hmm.best_path(sequence_queries.emissions(spark, d), sequence_queries.CHAIN, size=64)
    return categories.features_of_path(path, [(None, "+"), ("busy", "+")], ["seq"])


@query("fit_conserved_chain")
def fit_conserved_chain(spark, d):
    """Transitions and the conserved tree's scale by expectation-maximisation over runs of orders, until a round gains no more."""
    from pyspark.sql import Window

    rows = tree_queries.alignment(spark, d).withColumn("aln", F.expr("aln div 128"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("aln").orderBy("col")).cast("long"))
    fit = es.fit_conserved(rows, NAMES, tree_queries.model(), length=20.0, size=1024)
    return spark.createDataFrame([(i, v, float(fit.models[0].scale), float(fit.chain.transition[0, 1]), float(fit.chain.transition[1, 0])) for i, v in enumerate(fit.history)], "round int, loglik double, rho double, mu double, nu double")


# -- positions through alignments --------------------------------------------------------------------------------------

SEGMENTS = """segments AS (SELECT l_suppkey AS block, l_orderkey % 25 AS seqname, l_orderkey * 8 + l_linenumber AS qs, l_orderkey * 8 + l_linenumber + CAST(l_quantity AS BIGINT) % 5 AS qe,
(l_orderkey * 8 + l_linenumber) * 2 + l_suppkey AS ts FROM lineitem),
spans AS (SELECT o_orderkey AS id, o_orderkey % 25 AS seqname, o_orderkey * 8 AS start, o_orderkey * 8 + o_custkey % 400 AS "end" FROM orders)"""


def segments(spark, d):
    """Pairwise segments of order lines, and spans of orders that they cut."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    qs = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    more = F.col("l_quantity").cast("long") % 5
    pieces = li.select(F.col("l_suppkey").alias("block"), (F.col("l_orderkey") % 25).alias("seqname"), qs.alias("qs"), (qs + more).alias("qe"), (qs * 2 + F.col("l_suppkey")).alias("ts"), (qs * 2 + F.col("l_suppkey") + more).alias("te"))
    return pieces, o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 25).alias("seqname"), (F.col("o_orderkey") * 8).alias("start"), (F.col("o_orderkey") * 8 + F.col("o_custkey") % 400).alias("end"))


@query("transfer_features", f"""WITH {SEGMENTS} SELECT id, f.seqname, min(ts + greatest(f.start, qs) - qs) AS start, max(ts + least(f."end", qe) - qs) AS "end", block
FROM spans f JOIN segments s ON s.seqname = f.seqname AND f.start <= qe AND qs <= f."end" GROUP BY id, f.seqname, block""")
def transfer_features(spark, d):
    pieces, spans = segments(spark, d)
    return transfer.transfer_features(spans, pieces, "id", width=512)


GAPLESS = """gapless AS (SELECT seqname, min(start) AS qs, max(start) + 3 AS qe, min(event_id) * 1000 AS ts FROM feats GROUP BY seqname, start // 86400), parts AS (SELECT *, ts + qe - qs AS te FROM gapless),
points AS (SELECT event_id, seqname, "end" AS place FROM feats)"""


@query("target_positions", f"""WITH {FEATS}, {GAPLESS}, l AS (SELECT points.*, qs, qe, ts, te FROM points ASOF LEFT JOIN parts ON points.seqname = parts.seqname AND points.place >= parts.qs),
r AS (SELECT l.*, n.ts AS next FROM l ASOF LEFT JOIN parts n ON l.seqname = n.seqname AND l.place <= n.qe)
SELECT event_id, seqname, place, CASE WHEN place <= qe THEN ts + place - qs WHEN next IS NULL OR next >= te THEN te END AS target FROM r""")
def target_positions(spark, d):
    """Ends of events through one gapless segment for each user's day, or the last base before them."""
    feats = views.feats(spark, d)
    days = feats.groupBy("seqname", F.expr("start div 86400").alias("_day")).agg(F.min("start").alias("qs"), (F.max("start") + 3).alias("qe"), (F.min("event_id") * 1000).alias("ts"))
    parts = days.select("seqname", "qs", "qe", "ts", (F.col("ts") + F.col("qe") - F.col("qs")).alias("te"))
    points = feats.select("event_id", "seqname", F.col("end").alias("place"))
    return transfer.target_positions(points, parts, "place", bins=lambda at: F.floor(at / 604_800))


BLOCKS = """blocks AS (SELECT o_orderkey AS block, (o_orderkey * 7) % 5000 AS start, translate(substr(md5('r' || o_orderkey), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACG-') AS r, translate(substr(md5('s' || o_orderkey), 1, 12), '0123456789abcdef', 'ACGTACGTACGTAC--') AS s FROM orders)"""


def blocks(spark, d):
    """Blocks of two rows spelled by hashes of orders; they lie in no order and overlap in the reference r."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("block"), (F.col("o_orderkey") * 7 % 5000).alias("_at"))
    spell = lambda name, to: F.translate(F.substring(F.md5(F.concat(F.lit(name), F.col("block").cast("string")).cast("binary")), 1, 12), "0123456789abcdef", to)
    rows = F.explode(F.array(F.struct(F.lit(1).alias("k"), F.lit("r").alias("seq"), spell("r", "ACGTACGTACGTACG-").alias("text")), F.struct(F.lit(2).alias("k"), F.lit("s").alias("seq"), spell("s", "ACGTACGTACGTAC--").alias("text"))))
    each = o.select("block", "_at", rows.alias("x")).select("block", "x.k", F.concat("x.seq", F.lit(".1")).alias("src"), "x.seq", F.col("_at").alias("start"), "x.text")
    return each.select("block", "k", "src", "seq", "start", F.length(F.translate("text", "-", "")).cast("long").alias("size"), F.lit("+").alias("strand"), F.lit(10_000).cast("long").alias("src_size"), "text")


@query("unsorted_blocks", f"""WITH {BLOCKS}, c AS (SELECT block, i, start, substr(r, i, 1) AS a, substr(s, i, 1) AS b FROM blocks, generate_series(1, 12) g(i)),
p AS (SELECT *, start + sum(CASE WHEN a <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY i) AS pos FROM c)
SELECT CAST(pos AS BIGINT) AS pos, arg_min(a || b, block) AS col FROM p WHERE a <> '-' GROUP BY pos""")
def unsorted_blocks(spark, d):
    return transfer.unsorted_columns(blocks(spark, d), "r", ["r", "s"])


@query("cut_blocks", f"""WITH {BLOCKS}, c AS (SELECT block, i, start, substr(r, i, 1) AS a, substr(s, i, 1) AS b FROM blocks, generate_series(1, 12) g(i)),
p AS (SELECT *, start + sum(CASE WHEN a <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY i) AS pos, coalesce(sum(CASE WHEN b <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM c),
w AS (SELECT p.block, s_suppkey AS id, min(i) AS lo, max(i) AS hi FROM p JOIN supplier ON a <> '-' AND pos BETWEEN s_suppkey * 40 AND s_suppkey * 40 + 9 GROUP BY ALL)
SELECT id, p.block, CAST(min(start + gone) AS BIGINT) AS start, count(*) FILTER (WHERE b <> '-') AS size, string_agg(b, '' ORDER BY i) AS text FROM p JOIN w ON w.block = p.block AND i BETWEEN lo AND hi GROUP BY id, p.block""")
def cut_blocks(spark, d):
    """The second row of each block inside ten-base features of the reference."""
    feats = table(spark, d, "supplier").select(F.lit("r.1").alias("seqname"), (F.col("s_suppkey") * 40).alias("start"), (F.col("s_suppkey") * 40 + 9).alias("end"), F.col("s_suppkey").alias("id"))
    return transfer.cut_blocks(blocks(spark, d), "r", feats, "id").filter("seq = 's'").select("id", "block", "start", "size", "text")


# -- motifs ------------------------------------------------------------------------------------------------------------


@query("motif_conditional", """WITH t AS (SELECT doc_id, translate(lower(text), 'bdefhijklmnopqrsuvwxyz', 'cgtacgtacgtacgtacgtacg') AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
w(k, a, p) AS (VALUES (1, 'a', 0.7::DOUBLE), (1, 'c', 0.1::DOUBLE), (1, 'g', 0.1::DOUBLE), (1, 't', 0.1::DOUBLE), (2, 'a', 0.1::DOUBLE), (2, 'c', 0.6::DOUBLE), (2, 'g', 0.2::DOUBLE), (2, 't', 0.1::DOUBLE)),
o AS (SELECT doc_id, sum(coalesce(x.p * z.p * 16, 0)) / max(length(s) - 1) AS odds FROM (SELECT doc_id, s, unnest(range(1, length(s))) AS i FROM t) u LEFT JOIN w x ON x.k = 1 AND x.a = substr(s, i, 1) LEFT JOIN w z ON z.k = 2 AND z.a = substr(s, i + 1, 1) GROUP BY doc_id),
e AS (SELECT y, CASE WHEN coalesce(odds, 0) > 0 THEN odds ELSE 1.0 END AS odds FROM t LEFT JOIN o USING (doc_id))
SELECT round(sum(ln(CASE WHEN y THEN odds / (1 + odds) ELSE 1 / (1 + odds) END)), 5) AS value FROM e""")
def motif_conditional(spark, d):
    """The log-probability of documents' quality labels by a two-letter matrix over their texts, spelled in four letters."""
    import numpy as np

    from tessera.operators import motifs

    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    spelled = F.translate(F.lower("text"), "bdefhijklmnopqrsuvwxyz", "cgtacgtacgtacgtacgtacg")
    rows = docs.join(labels, "doc_id").select(spelled.alias("text"), (F.col("quality") == 1).alias("label"))
    theta = np.log(np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1]]))
    value, _ = motifs.conditional(rows, theta, 0.0, np.full(4, 0.25))
    return spark.createDataFrame([(round(value, 5),)], "value double")
