"""General relational forms: joins of all kinds, grouping sets, ranking, set operations, dates, JSON, maps and strings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import sequences as sq
from tessera.plans.registry import query
from tessera.runtime import table


@query("join_equi", "SELECT o_orderpriority, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def join_equi(spark, d):
    met = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return met.groupBy("o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join_outer", "SELECT c_custkey, s_suppkey, c_nationkey AS nation FROM customer FULL JOIN supplier ON c_custkey = 20 * s_suppkey")
def join_outer(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, F.col("c_custkey") == 20 * F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey", F.col("c_nationkey").alias("nation"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 200000")
    return table(spark, d, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("join_range", "SELECT r.k, count(*) AS n FROM part p JOIN (VALUES (1, 0, 1000), (2, 500, 1500), (3, 1400, 9000)) r(k, lo, hi) ON p_retailprice BETWEEN lo AND hi GROUP BY r.k")
def join_range(spark, d):
    bands = spark.createDataFrame([(1, 0, 1000), (2, 500, 1500), (3, 1400, 9000)], "k int, lo int, hi int")
    p = table(spark, d, "part")
    return p.join(F.broadcast(bands), F.col("p_retailprice").between(F.col("lo"), F.col("hi"))).groupBy("k").agg(F.count(F.lit(1)).alias("n"))  # three rows


@query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def agg_grouping_sets(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("agg_cube", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"))


@query("rank_top_per_group", "SELECT c_mktsegment, c_custkey, rnk FROM (SELECT c_mktsegment, c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rnk FROM customer) WHERE rnk <= 5")
def rank_top_per_group(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, d, "customer").select("c_mktsegment", "c_custkey", F.rank().over(w).cast("long").alias("rnk")).filter("rnk <= 5")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("lag_lead", "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2) OVER w AS after, first_value(event_type) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type", 2).over(w).alias("after"), F.first("event_type").over(w).alias("first"))


@query("set_operations", """SELECT 'both' AS side, k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'left', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def set_operations(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o).select(F.lit("both").alias("side"), "k").unionByName(c.subtract(o).select(F.lit("left").alias("side"), "k"))


@query("date_functions", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS due FROM orders")
def date_functions(spark, d):
    at = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.year(at).alias("y"), F.quarter(at).alias("q"), F.month(at).alias("m"), F.date_format(F.trunc(at, "month"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.date_add(at, 30), "yyyy-MM-dd").alias("due"))


@query("json_field", """SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_field(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("map_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def map_counts(spark, d):
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.coalesce(F.element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"), F.size(F.map_keys("m")).cast("long").alias("kinds"))


@query("array_functions", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive, list_position(embedding, list_max(embedding)) AS best FROM embeddings")
def array_functions(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"), F.array_position("embedding", F.array_max("embedding")).cast("int").alias("best"))


@query("explode_words", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word HAVING count(*) > 50")
def explode_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 50")


@query("weighted_mean", "SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean, min(l_extendedprice) AS low FROM lineitem GROUP BY l_suppkey")
def weighted_mean(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * q) / F.sum(q), 4).alias("mean"), F.min("l_extendedprice").alias("low"))


@query("string_scalars", """SELECT page_id, regexp_replace(url, '\\.[^.]*$', '') AS root, split_part(url, '.', 1) AS short_root, string_split(url, '/')[-1] AS base, regexp_replace(url, '\\s+', '', 'g') AS tight,
instr(url, '/') - 1 AS slash, starts_with(url, 'https') AS secure, ends_with(url, '/') AS folder, upper(url) AS big FROM pages""")
def string_scalars(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", sq.root(u).alias("root"), sq.shortest_root(u).alias("short_root"), sq.basename(u).alias("base"), sq.remove_whitespace(u).alias("tight"), sq.index_of(u, "/").cast("long").alias("slash"), sq.starts_with(u, "https").alias("secure"), sq.ends_with(u, "/").alias("folder"), F.upper(u).alias("big"))


@query("kmer_codes", """WITH c AS (SELECT doc_id, string_split(translate(lower(text), 'aeion', 'ACGTT'), '') AS l FROM documents),
d AS (SELECT doc_id, strpos('ACGT', unnest(l)) - 1 AS x, generate_subscripts(l, 1) AS i FROM c),
k AS (SELECT x AS a, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c, lead(x, 3) OVER w AS d FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT CASE WHEN least(a, b, c, d) < 0 THEN -1 ELSE 64 * a + 16 * b + 4 * c + d END AS code, count(*) AS n FROM k WHERE d IS NOT NULL GROUP BY 1""")
def kmer_codes(spark, d):
    return sq.kmer_counts(table(spark, d, "documents"), F.translate(F.lower("text"), "aeion", "ACGTT"), 4)


@query("conversation_turns", """SELECT conv_id, count(*) AS turns, max(turn) AS last, string_agg(role, '>' ORDER BY turn) AS path FROM conversations GROUP BY conv_id""")
def conversation_turns(spark, d):
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last"), F.array_join(parts, ">").alias("path"))
