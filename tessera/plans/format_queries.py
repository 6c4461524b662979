"""Queries that write a format and read it back, and tables of models and densities, each against SQL over the tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions as ds
from tessera.functions import models as md
from tessera.plans import views
from tessera.plans.registry import query
from tessera.plans.views import FEATS, TUPLES
from tessera.runtime import own, shared_dir, stage, unstage
from tessera.sources import alignments, features


def _written(spark: SparkSession, lines: DataFrame) -> str:
    """The folder that the lines were written to."""
    path = own(f"{shared_dir(spark)}/tessera-text-{uuid.uuid4().hex}")
    features.write(lines, path)
    return path


# -- features ----------------------------------------------------------------------------------------------------------


def _named(spark, d):
    feats = views.feats(spark, d).withColumn("attribute", F.concat(F.lit('id "e'), "event_id", F.lit('"')))
    return feats.withColumn("seqname", F.col("seqname").cast("string")).withColumn("source", F.lit("test"))


@query("gff_round_trip", f"""WITH {FEATS} SELECT CAST(seqname AS VARCHAR) AS seqname, 'test' AS source, feature, start, "end", score, strand, frame, 'id "e' || event_id || '"' AS attribute FROM feats""")
def gff_round_trip(spark, d):
    return features.read_gff(spark, _written(spark, features.gff_lines(_named(spark, d))))


@query("bed_round_trip", f"""WITH {FEATS} SELECT CAST(seqname AS VARCHAR) AS seqname, start, "end", CAST(trunc(score) AS DOUBLE) AS score, strand, 'id "e' || event_id || '"' AS attribute FROM feats""")
def bed_round_trip(spark, d):
    out = features.read_bed(spark, _written(spark, features.bed_lines(_named(spark, d))))
    return out.select("seqname", "start", "end", "score", "strand", "attribute")


@query("bed_blocks_round_trip", f"""WITH {TUPLES} SELECT 'c' || aln % 7 AS seqname, 1000 * pos AS start, 1000 * pos + 10 + cat AS "end", 'id "g' || aln || '"' AS attribute FROM cols""")
def bed_blocks_round_trip(spark, d):
    """Every order as one line of blocks."""
    out = features.read_bed(spark, _written(spark, features.bed_lines(_exons(spark, d), "grp")))
    return out.select("seqname", "start", "end", "attribute")


def _exons(spark, d):
    """Every order as a gene with an exon for each line."""
    c = views.columns(spark, d)
    start = (1000 * F.col("pos")).cast("long")
    return c.select(F.concat(F.lit("c"), (F.col("aln") % 7).cast("string")).alias("seqname"), F.concat(F.lit("g"), F.col("aln").cast("string")).alias("grp"), F.when(F.col("aln") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit("exon").alias("feature"), start.alias("start"), (start + 10 + F.col("cat")).alias("end"))


@query("genepred_round_trip", f"""WITH {TUPLES}, e AS (SELECT 'c' || aln % 7 AS seqname, 'transcript_id "g' || aln || '"' AS attribute, CASE WHEN aln % 2 = 0 THEN '+' ELSE '-' END AS strand, 1000 * pos AS start, 1000 * pos + 10 + cat AS "end" FROM cols)
SELECT *, 'exon' AS feature, CAST(NULL AS INTEGER) AS frame FROM e UNION ALL
SELECT *, 'CDS', CAST(coalesce(sum("end" - start + 1) OVER (PARTITION BY attribute ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3 AS INTEGER) FROM e""")
def genepred_round_trip(spark, d):
    exons = _exons(spark, d)
    out = features.read_genepred(spark, _written(spark, features.genepred_lines(exons.unionByName(exons.withColumn("feature", F.lit("CDS"))))))
    return out.select("seqname", "attribute", "strand", "start", "end", "feature", "frame")


# -- alignments --------------------------------------------------------------------------------------------------------


def _records(spark, d):
    """Every order's columns as one sequence."""
    return views.alignments(spark, d).select(F.concat(F.lit("o"), F.col("aln").cast("string")).alias("seq"), F.array_join("cols", "").alias("text"))


@query("fasta_round_trip", f"WITH {TUPLES} SELECT 'o' || aln AS seq, string_agg(col, '' ORDER BY pos) AS text FROM cols GROUP BY aln")
def fasta_round_trip(spark, d):
    return alignments.read_fasta(spark, _written(spark, alignments.fasta_lines(_records(spark, d), 7))).select("seq", "text")


@query("counts_round_trip", f"WITH {TUPLES} SELECT col AS tuple, CAST(count(*) AS DOUBLE) AS cnt FROM cols GROUP BY col")
def counts_round_trip(spark, d):
    counts = views.columns(spark, d).groupBy(F.col("col").alias("tuple")).agg(F.count(F.lit(1)).alias("cnt"))
    out, head = alignments.read_counts(spark, _written(spark, alignments.counts_lines(counts, ["a", "b", "c"], 1).coalesce(1)))
    if head["NAMES"] != "a,b,c":
        raise ValueError("the header did not come back")
    return out.select("tuple", "cnt")


@query("maf_round_trip", f"""WITH {TUPLES}, r AS (SELECT aln, k, string_agg(substr(col, CAST(k AS BIGINT) + 1, 1), '' ORDER BY pos) AS text FROM cols, range(3) r(k) GROUP BY aln, k)
SELECT 's' || k || '.c1' AS src, 's' || k AS seq, 10 * aln AS start, length(replace(text, '-', '')) AS size, '+' AS strand, 1000000000 AS src_size, text FROM r""")
def maf_round_trip(spark, d):
    """Orders are staged as three texts and dealt by ranges once: sorting the blocks then moves nothing and runs nothing twice."""
    text = lambda k: F.array_join(F.transform("cols", lambda x: F.substring(x, k + 1, 1)), "")
    wide = stage(views.alignments(spark, d).select("aln", *[text(k).alias(f"t{k}") for k in range(3)]), "maf")
    dealt = wide.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "aln")
    line = lambda k: alignments.maf_line(F.lit(f"s{k}.c1"), 10 * F.col("aln"), F.length(F.replace(f"t{k}", F.lit("-"))), F.lit("+"), F.lit(1_000_000_000), F.col(f"t{k}"))
    path = _written(spark, alignments.maf_blocks(dealt.select(F.col("aln").alias("block"), F.array(*[line(k) for k in range(3)]).alias("lines"))))
    unstage(wide)
    return alignments.read_maf(spark, path).select("src", "seq", "start", "size", "strand", "src_size", "text")


# -- models and densities ----------------------------------------------------------------------------------------------

PI = (0.3, 0.2, 0.15, 0.35)
EXCHANGE = (1.0, 2.5, 0.7, 1.3, 3.1, 0.9)
BASES = "bases(model, i, x, pi) AS (" + " UNION ALL ".join(f"SELECT '{m}', {i}, '{'ACGT'[i]}', {p!r}::DOUBLE" for m in ("JC69", "K80", "F81", "HKY85", "GC", "REV", "SSREV") for i, p in enumerate((0.25,) * 4 if m in ("JC69", "K80") else [(a + b) / 2 for a, b in zip(PI, PI[::-1])] if m == "SSREV" else PI)) + ")"
RATES = f"""{BASES}, pairs AS (SELECT a.model, a.i, b.i AS j, a.pi AS pi_i, b.pi AS pi_j, a.x || b.x AS change, least(a.x, b.x) || greatest(a.x, b.x) AS pair FROM bases a JOIN bases b ON a.model = b.model AND a.i <> b.i),
raw AS (SELECT *, pi_j * CASE WHEN model IN ('JC69', 'F81') THEN 1 WHEN model = 'REV' THEN CASE pair WHEN 'AC' THEN 1.0 WHEN 'AG' THEN 2.5 WHEN 'AT' THEN 0.7 WHEN 'CG' THEN 1.3 WHEN 'CT' THEN 3.1 ELSE 0.9 END
WHEN model = 'SSREV' THEN CASE WHEN pair IN ('AC', 'GT') THEN 1.0 WHEN pair IN ('AG', 'CT') THEN 2.5 WHEN pair = 'AT' THEN 0.7 ELSE 1.3 END
ELSE CASE WHEN pair IN ('AG', 'CT') THEN 3.0 ELSE 1.0 END * CASE WHEN model = 'GC' AND change IN ('AC', 'AG', 'TC', 'TG') THEN 1.7 ELSE 1.0 END END AS q FROM pairs),
scale AS (SELECT model, sum(pi_i * q) AS s FROM raw GROUP BY model), off AS (SELECT raw.model, i, j, q / s AS q FROM raw JOIN scale USING (model)),
rates AS (SELECT * FROM off UNION ALL SELECT model, i, i, -sum(q) FROM off GROUP BY model, i)"""


def _matrices() -> dict[str, np.ndarray]:
    pi, ex = np.array(PI), np.array(EXCHANGE)
    return {"JC69": md.jc69()[0], "K80": md.k80(3.0)[0], "F81": md.f81(pi), "HKY85": md.hky85(pi, 3.0), "GC": md.gc_model(pi, 3.0, 1.7), "REV": md.reversible(pi, ex), "SSREV": md.strand_symmetric(pi, ex[:4])}


@query("rate_matrices", f"WITH {RATES} SELECT model, i, j, round(q, 9) AS q FROM rates")
def rate_matrices(spark, d):
    rows = [(m, i, j, round(float(q[i, j]), 9)) for m, q in _matrices().items() for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "model string, i int, j int, q double")


@query("substitution_chances", f"""WITH RECURSIVE {RATES}, power AS (SELECT model, i, j, 0 AS k, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM rates
UNION ALL SELECT model, i, j, k + 1, sum(p) FROM (SELECT a.model, a.i, b.j, a.k, a.p * b.q * 0.4 / (a.k + 1) AS p FROM power a JOIN rates b ON a.model = b.model AND a.j = b.i WHERE a.k < 40) GROUP BY model, i, j, k)
SELECT model, i, j, round(sum(p), 8) AS p FROM power GROUP BY model, i, j""")
def substitution_chances(spark, d):
    """The chances of all changes over a branch of 0.4, against the series of the exponential."""
    found = {m: md.expm(q, np.array([0.4]))[0] for m, q in _matrices().items()}
    return spark.createDataFrame([(m, i, j, round(float(p[i, j]), 8)) for m, p in found.items() for i in range(4) for j in range(4)], "model string, i int, j int, p double")


@query("densities", """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS l, l_quantity AS q, l_discount AS r, l_extendedprice AS e FROM lineitem)
SELECT k, l, e, round(exp(2.5 * ln(0.3) + 1.5 * ln(q) - 0.3 * q - lgamma(2.5)), 9) AS gamma, round(exp(1.5 * ln(0.5) + 0.5 * ln(q) - 0.5 * q - lgamma(1.5)), 9) AS chisq,
round(exp(lgamma(5.5) - lgamma(2.0) - lgamma(3.5) + ln((q + 1) / 60) + 2.5 * ln(1 - (q + 1) / 60)), 9) AS beta, round(exp(q * ln(20.0) - 20.0 - lgamma(q + 1)), 9) AS poisson FROM x""")
def densities(spark, d):
    from tessera.runtime import table

    q = F.col("l_quantity").cast("double")
    pmf = [float(p) for p in ds.poisson(20.0)]
    one = lambda f: ds.vectorised(f)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_extendedprice").alias("e"),
        F.round(one(lambda x: ds.gamma_pdf(x, 2.5, 0.3))(q), 9).alias("gamma"), F.round(one(lambda x: ds.chisq_pdf(x, 3))(q), 9).alias("chisq"),
        F.round(one(lambda x: ds.beta_pdf((x + 1) / 60, 2.0, 3.5))(q), 9).alias("beta"), F.round(one(lambda x: pmf[int(x)] if x < len(pmf) else 0.0)(q), 9).alias("poisson"),
    )
