"""Queries on distributions and predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import distributions as ds
from tessera.functions.digests import md5_leading
from tessera.operators import markov
from tessera.plans.registry import query
from tessera.runtime import table

PMF = "h AS (SELECT CAST(l_quantity AS BIGINT) AS x, count(*) AS cnt FROM lineitem GROUP BY 1), p AS (SELECT x, cnt, cnt / sum(cnt) OVER () AS p FROM h)"


@query("pmf", f"WITH {PMF} SELECT x, cnt, round(p, 9) AS p FROM p")
def pmf(spark, d):
    return ds.pmf_table(table(spark, d, "lineitem"), "l_quantity").withColumn("p", F.round("p", 9))


@query("cdf", f"WITH {PMF} SELECT x, round(sum(p) OVER (ORDER BY x), 9) AS lower, round(sum(p) OVER (ORDER BY x DESC), 9) AS upper FROM p")
def cdf(spark, d):
    p = ds.to_array(ds.pmf_table(table(spark, d, "lineitem"), "l_quantity"))
    low, up = ds.cdf(p), ds.cdf(p, upper=True)
    return spark.createDataFrame([(i, round(float(low[i]), 9), round(float(up[i]), 9)) for i in range(len(p)) if p[i] > 0], "x long, lower double, upper double")


@query("pmf_moments", f"WITH {PMF} SELECT round(sum(x * p), 6) AS mean, round(sum(x * x * p) - sum(x * p) * sum(x * p), 5) AS variance FROM p")
def pmf_moments(spark, d):
    m, v = ds.mean_var(ds.to_array(ds.pmf_table(table(spark, d, "lineitem"), "l_quantity")))
    return spark.createDataFrame([(round(m, 6), round(v, 5))], "mean double, variance double")


@query("pv_pvalue", f"WITH {PMF}, v(x0) AS (VALUES (3), (25), (48)) SELECT CAST(x0 AS BIGINT) AS x0, round(sum(p) FILTER (WHERE x <= x0), 9) AS lower, round(sum(p) FILTER (WHERE x >= x0), 9) AS upper, round(least(1, 2 * least(sum(p) FILTER (WHERE x <= x0), sum(p) FILTER (WHERE x >= x0))), 9) AS both FROM p, v GROUP BY x0")
def pv_pvalue(spark, d):
    p = ds.to_array(ds.pmf_table(table(spark, d, "lineitem"), "l_quantity"))
    return spark.createDataFrame([(x, *[round(ds.p_value(p, x, s), 9) for s in ("lower", "upper", "both")]) for x in (3, 25, 48)], "x0 long, lower double, upper double, both double")


@query("convolve2", f"WITH {PMF} SELECT a.x + b.x AS x, round(sum(a.p * b.p), 8) AS p FROM p a, p b GROUP BY 1 HAVING sum(a.p * b.p) > 1e-9")
def convolve2(spark, d):
    p = ds.convolve(ds.to_array(ds.pmf_table(table(spark, d, "lineitem"), "l_quantity")), 2, epsilon=0.0)
    return spark.createDataFrame([(i, round(float(x), 8)) for i, x in enumerate(p) if x > 1e-9], "x long, p double")


@query("quantiles_exact", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.05), 4) AS q05, round(quantile_cont(c_acctbal, 0.5), 4) AS q50, round(quantile_cont(c_acctbal, 0.95), 4) AS q95 FROM customer GROUP BY c_mktsegment")
def quantiles_exact(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy("c_mktsegment").agg(*[F.round(F.percentile("c_acctbal", q), 4).alias(f"q{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)])


@query("summary_stats", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS stdev, round(median(c_acctbal), 4) AS median, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_mktsegment")
def summary_stats(spark, d):
    x = "c_acctbal"
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("stdev"), F.round(F.percentile(x, 0.5), 4).alias("median"), F.min(x).alias("low"), F.max(x).alias("high"))


@query("prediction_eval", """WITH x AS (SELECT quality = 1 AS t, n_chars > 600 AS c FROM labels JOIN documents USING (doc_id)), n AS (SELECT
count(*) FILTER (WHERE t AND c)::DOUBLE AS tp, count(*) FILTER (WHERE NOT t AND c)::DOUBLE AS fp, count(*) FILTER (WHERE t AND NOT c)::DOUBLE AS fn, count(*) FILTER (WHERE NOT t AND NOT c)::DOUBLE AS tn FROM x)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / (tp + fn), 6) AS sn, round(tp / (tp + fp), 6) AS sp,
round((tp * tn - fn * fp) / sqrt((tp + fn) * (tn + fp) * (tp + fp) * (tn + fn)), 6) AS cc,
round((tp / (tp + fn) + tp / (tp + fp) + tn / (tn + fp) + tn / (tn + fn)) / 2 - 1, 6) AS ac FROM n""")
def prediction_eval(spark, d):
    met = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    out = markov.confusion(met, F.col("quality") == 1, F.col("n_chars") > 600)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("sn", "sp", "cc", "ac")])


@query("lrt_pvalue")
def lrt_pvalue(spark, d):
    """Likelihood ratio of a user's own rate of purchases against everyone's, with its chi-square tail."""
    e = table(spark, d, "events")
    per = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("k"))
    all_ = per.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    p0 = all_["k"] / all_["n"]

    def loglik(p):
        return F.when(F.col("k") > 0, F.col("k") * F.ln(p)).otherwise(0.0) + F.when(F.col("n") > F.col("k"), (F.col("n") - F.col("k")) * F.ln(1 - p)).otherwise(0.0)

    lr = F.greatest(2 * (loglik(F.col("k") / F.col("n")) - loglik(F.lit(p0))), F.lit(0.0))
    tail = ds.vectorised(lambda x: max(ds.chisq_cdf(x, 1, lower=False), ds.LEAST_P))
    return per.withColumn("lr", lr).withColumn("p", tail("lr")).select("user_id", "k", "n", F.round("lr", 6).alias("lr"), F.round("p", 6).alias("p"))


@query("nearest_code", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS code, i, avg(x::DOUBLE) AS m FROM e GROUP BY ALL),
s AS (SELECT e.vec_id, c.code, sum((e.x - c.m) * (e.x - c.m)) AS dist FROM e JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, arg_min(code, dist) AS code FROM s GROUP BY vec_id""")
def nearest_code(spark, d):
    """Each vector's nearest label mean: the code book is one row for each label, so it is broadcast after a check."""
    e = table(spark, d, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("i", "x"))
    book = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    codes = [(r["label"], [float(x) for x in r["mean"]]) for r in book.limit(4097).collect()]
    if len(codes) > 4096:
        raise ValueError("the code book is too large")
    names, means = np.array([c for c, _ in codes]), np.array([m for _, m in codes])

    @F.pandas_udf("int")
    def nearest(x):
        import pandas as pd

        v = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, means.shape[1]))
        return pd.Series(names[((v[:, None, :] - means[None]) ** 2).sum(2).argmin(1)] if len(x) else [])

    return e.select("vec_id", nearest("embedding").alias("code"))


@query("sample_k", "SELECT * FROM orders ORDER BY md5('11:' || o_orderkey), o_orderkey LIMIT 100")
def sample_k(spark, d):
    """A seeded uniform sample of 100 orders: those with the least MD5 of seed and key."""
    key = F.md5(F.concat(F.lit("11:"), F.col("o_orderkey").cast("string")).cast("binary"))
    return table(spark, d, "orders").orderBy(key, "o_orderkey").limit(100)


CUTS = [float(c) for c in np.cumsum(ds.poisson(1.0)) if c < 1 - 1e-12]



def _resampled(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[pa.RecordBatch]:
    """For each round the sums of weights and of weighted values; a weight is drawn from the first 28 bits of the MD5 of key and round."""
    limits = [np.uint32(int(c * (1 << 28))) for c in CUTS]
    tails = [f":{rep}".encode() for rep in range(rounds)]
    wx, ws = np.zeros(rounds), np.zeros(rounds, np.int64)
    for batch in batches:
        keys, x = batch.column(0).to_numpy(zero_copy_only=False).astype(bytes), batch.column(1).to_numpy()
        lengths = np.char.str_len(keys)
        for length in np.unique(lengths):
            some = lengths == length
            drawn = md5_leading(keys[some].astype(f"S{length}").view(np.uint8).reshape(-1, length), tails)
            drawn >>= np.uint32(4)
            for rep, u in enumerate(drawn):
                w = np.zeros(len(u), np.uint8)
                for limit in limits:
                    w += u > limit
                wx[rep] += w @ x[some]
                ws[rep] += int(w.sum(dtype=np.int64))
    yield pa.RecordBatch.from_pydict({"rep": pa.array(np.arange(rounds, dtype=np.int32)), "wx": pa.array(wx), "w": pa.array(ws)})

@query("bootstrap", f"""WITH u AS (SELECT rep, o_totalprice AS x, ('0x' || substr(md5(o_orderkey || ':' || rep), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM orders, range(200) r(rep)),
w AS (SELECT rep, x, {" + ".join(f"CASE WHEN u > {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in CUTS)} AS w FROM u), m AS (SELECT rep, sum(w * x) / sum(w) AS m FROM w GROUP BY rep),
s AS (SELECT avg(m) AS mean, stddev_samp(m) AS stdev, median(m) AS median, min(m) AS "min", max(m) AS "max", quantile_cont(m, 0.025) AS low95, quantile_cont(m, 0.975) AS high95, quantile_cont(m, 0.05) AS low90, quantile_cont(m, 0.95) AS high90 FROM m)
SELECT stat, round(value, 4) AS value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME stat VALUE value)""")
def bootstrap(spark, d):
    """200 resamples of the mean order price by Poisson weights drawn from hashes, and their summary."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.coalesce("o_totalprice", F.lit(0.0)).alias("x")).filter("key is not null")
    spread = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")  # a row is 200 draws: files are too few tasks
    sums = spread.mapInArrow(lambda batches: _resampled(batches, 200), "rep int, wx double, w long").groupBy("rep").agg(F.sum("wx").alias("wx"), F.sum("w").alias("w"))
    means = sums.select((F.col("wx") / F.col("w")).alias("m"))
    s = ds.summary(np.array([r["m"] for r in means.collect()]))
    return spark.createDataFrame([(k, round(v, 4)) for k, v in s.items()], "stat string, value double")
