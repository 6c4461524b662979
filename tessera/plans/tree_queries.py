"""Queries on trees and tree likelihoods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import distributions as ds
from tessera.functions import models as md
from tessera.operators import likelihood as lk
from tessera.operators import trees, tuples
from tessera.plans import views
from tessera.plans.registry import query
from tessera.plans.views import EDGES
from tessera.runtime import table

CLOSURE = f"""RECURSIVE {EDGES}, up AS (SELECT node, parent AS ancestor, 1 AS dist, len AS length FROM edges
UNION ALL SELECT up.node, e.parent, up.dist + 1, up.length + e.len FROM up JOIN edges e ON e.node = up.ancestor),
closure AS (SELECT * FROM up UNION ALL SELECT node, node, 0, 0.0 FROM edges UNION ALL SELECT 'root', 'root', 0, 0.0)"""


@query("tree_closure", f"WITH {CLOSURE} SELECT node, ancestor, CAST(dist AS INTEGER) AS dist, length FROM closure")
def tree_closure(spark, d):
    return trees.closure(views.edges(spark, d))


@query("subtree_agg", f"""WITH {CLOSURE} SELECT ancestor, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM closure JOIN supplier ON node = 's' || s_suppkey GROUP BY ancestor""")
def subtree_agg(spark, d):
    values = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), "s_acctbal")
    return trees.subtree_aggregate(trees.closure(views.edges(spark, d)), values, [F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total")])


@query("tree_lca", f"""WITH {CLOSURE}, p AS (SELECT 's' || a.s_suppkey AS a, 's' || b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1),
m AS (SELECT p.a, p.b, x.ancestor AS lca, x.dist AS dist, x.length + y.length AS path FROM p JOIN closure x ON x.node = p.a JOIN closure y ON y.node = p.b AND y.ancestor = x.ancestor)
SELECT a, b, arg_min(lca, dist) AS lca, arg_min(path, dist) AS path FROM m GROUP BY a, b""")
def tree_lca(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey")
    pairs = s.join(s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("k2")), "s_suppkey").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("s"), "k2").alias("b"))
    return trees.lca_pairs(trees.closure(views.edges(spark, d)), pairs)


@query("leaf_distance", f"""WITH {CLOSURE} SELECT node, length AS depth FROM closure WHERE ancestor = 'root' AND node LIKE 's%'""")
def leaf_distance(spark, d):
    return trees.closure(views.edges(spark, d)).filter("ancestor = 'root' and node like 's%'").select("node", F.col("length").alias("depth"))


NAMES = ("a", "b", "c", "d")
TREE = "((a:0.1,b:0.2):0.05,(c:0.3,d:0.1):0.15);"


def alignment(spark, d):
    """Four rows of bases: each order line's number, flags and dates spell a column."""
    li = table(spark, d, "lineitem")
    base = lambda x: F.substring(F.lit("ACGT"), x.cast("int") + 1, 1)
    m = F.month("l_shipdate") % 4
    col = F.concat(base(m), base(F.when(F.col("l_linenumber") % 3 == 0, (m + 1) % 4).otherwise(m)), base(F.when(F.col("l_quantity") > 35, (m + 2) % 4).otherwise(m)), F.when(F.col("l_quantity") < 3, "-").otherwise(base(F.when(F.col("l_discount") > 0.07, (m + 1) % 4).otherwise(m))))
    return li.select(F.col("l_orderkey").alias("aln"), col.alias("col"))


def counts(spark, d):
    return tuples.tuple_counts(alignment(spark, d).withColumn("tuple", F.col("col")))


def model():
    pi = np.array([0.3, 0.2, 0.2, 0.3])
    return md.TreeModel.gamma(trees.parse(TREE), md.hky85(pi, 3.0), pi, 0.8, 4)


#: The same model for the second engine, by the closed form of its transition chances: A and G, and C and T, have half of
#: all bases each; the rates are the gamma classes' means.
LIKELIHOOD = f"""cols AS (SELECT substr('ACGT', m + 1, 1) || substr('ACGT', CASE WHEN l_linenumber % 3 = 0 THEN (m + 1) % 4 ELSE m END + 1, 1) || substr('ACGT', CASE WHEN l_quantity > 35 THEN (m + 2) % 4 ELSE m END + 1, 1)
|| CASE WHEN l_quantity < 3 THEN '-' ELSE substr('ACGT', CASE WHEN l_discount > 0.07 THEN (m + 1) % 4 ELSE m END + 1, 1) END AS col FROM (SELECT *, CAST(month(l_shipdate) % 4 AS INTEGER) AS m FROM lineitem)),
tuples AS (SELECT col AS tuple, count(*) AS cnt FROM cols GROUP BY col),
rates(rate) AS (VALUES {", ".join(f"({float(r)!r}::DOUBLE)" for r in ds.discrete_gamma(0.8, 4))}),
bases(x, pi, kind) AS (VALUES ('A', 0.3::DOUBLE, 0), ('C', 0.2::DOUBLE, 1), ('G', 0.2::DOUBLE, 0), ('T', 0.3::DOUBLE, 1)),
branches(branch, len) AS (VALUES ('a', 0.1::DOUBLE), ('b', 0.2::DOUBLE), ('ab', 0.05::DOUBLE), ('c', 0.3::DOUBLE), ('d', 0.1::DOUBLE), ('cd', 0.15::DOUBLE)),
p AS (SELECT rate, branch, i.x AS i, j.x AS j, j.pi * (1 - exp(-t)) + CASE WHEN i.kind = j.kind THEN 2 * j.pi * (exp(-t) - exp(-2 * t)) ELSE 0 END + CASE WHEN i.x = j.x THEN exp(-2 * t) ELSE 0 END AS p
FROM (SELECT rate, branch, len * rate / 1.22 AS t FROM rates, branches), bases i, bases j),
leaf AS (SELECT rate, branch, i, j AS c, p FROM p UNION ALL SELECT DISTINCT rate, branch, i, '-', 1.0::DOUBLE FROM p),
ab AS (SELECT tuple, a.rate, a.i, a.p * b.p AS p FROM tuples JOIN leaf a ON a.branch = 'a' AND a.c = substr(tuple, 1, 1) JOIN leaf b ON b.branch = 'b' AND b.c = substr(tuple, 2, 1) AND b.rate = a.rate AND b.i = a.i),
cd AS (SELECT tuple, a.rate, a.i, a.p * b.p AS p FROM tuples JOIN leaf a ON a.branch = 'c' AND a.c = substr(tuple, 3, 1) JOIN leaf b ON b.branch = 'd' AND b.c = substr(tuple, 4, 1) AND b.rate = a.rate AND b.i = a.i),
up_ab AS (SELECT tuple, p.rate, p.i, sum(p.p * ab.p) AS p FROM ab JOIN p ON p.branch = 'ab' AND p.rate = ab.rate AND p.j = ab.i GROUP BY ALL),
up_cd AS (SELECT tuple, p.rate, p.i, sum(p.p * cd.p) AS p FROM cd JOIN p ON p.branch = 'cd' AND p.rate = cd.rate AND p.j = cd.i GROUP BY ALL),
root AS (SELECT l.tuple, l.rate, l.i, pi * l.p * r.p AS p FROM up_ab l JOIN up_cd r USING (tuple, rate, i) JOIN bases ON x = l.i),
whole AS (SELECT tuple, sum(p) AS p FROM root GROUP BY tuple)"""


@query("tree_loglik", f"WITH {LIKELIHOOD} SELECT tuple, cnt, round(ln(p / 4), 8) AS loglik FROM tuples JOIN whole USING (tuple)")
def tree_loglik(spark, d):
    return lk.score_tuples(counts(spark, d), NAMES, model()).withColumn("loglik", F.round("loglik", 8))


def _inner(node: str, here: str, branch: str, other: str) -> str:
    return f"""SELECT {here}.tuple, '{node}' AS node, {here}.i AS base, sum(pi * p.p * {here}.p * o.p) AS p FROM {here} JOIN p ON p.branch = '{branch}' AND p.rate = {here}.rate AND p.j = {here}.i
JOIN {other} o ON o.tuple = {here}.tuple AND o.rate = {here}.rate AND o.i = p.i JOIN bases ON x = p.i GROUP BY {here}.tuple, {here}.i"""


@query("ancestral_posteriors", f"""WITH {LIKELIHOOD}, nodes AS (SELECT tuple, '0' AS node, i AS base, sum(p) AS p FROM root GROUP BY tuple, i UNION ALL {_inner("1", "ab", "ab", "up_cd")} UNION ALL {_inner("4", "cd", "cd", "up_ab")})
SELECT tuple, node, base, round(nodes.p / whole.p, 8) AS p FROM nodes JOIN whole USING (tuple)""")
def ancestral_posteriors(spark, d):
    return lk.ancestors(counts(spark, d), NAMES, model()).withColumn("p", F.round("p", 8))


@query("site_tests_lrt")
def site_tests_lrt(spark, d):
    out = lk.test_tuples(counts(spark, d), NAMES, model(), "LRT")
    return out.select("tuple", *[F.round(c, 5).alias(c) for c in out.columns[1:]])


@query("site_tests_score")
def site_tests_score(spark, d):
    return lk.test_tuples(counts(spark, d), NAMES, model(), "SCORE")


@query("site_tests_gerp")
def site_tests_gerp(spark, d):
    return lk.test_tuples(counts(spark, d), NAMES, model(), "GERP")


@query("fit_tree_model")
def fit_tree_model(spark, d):
    fitted, value = lk.fit(counts(spark, d), NAMES, trees.parse(TREE), "HKY85")
    return spark.createDataFrame([(trees.newick(fitted.tree, 4), round(value, 3))], "tree string, loglik double")


@query("conserved_elements")
def conserved_elements(spark, d):
    from pyspark.sql import Window

    rows = alignment(spark, d).withColumn("aln", F.expr("aln div 128"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("aln").orderBy("col")).cast("long"))
    return lk.conserved_posteriors(rows, NAMES, model(), length=20.0)[1]
