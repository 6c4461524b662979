"""Queries of the interval algebra on users' events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import intervals as iv
from tessera.plans import views
from tessera.plans.registry import query
from tessera.plans.views import FEATS

KEYS = ("seqname",)
DAY = 1 << 17  # positions are seconds here: bins of a day and a half


def _islands(source: str, by: str, gap: int, aggs: str = "") -> str:
    return f"""
  SELECT {by}, min(start) AS start, max("end") AS "end"{aggs} FROM (
    SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY {by} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}
                       OR lag(start) OVER (PARTITION BY {by} ORDER BY start, "end") IS NULL THEN 1 ELSE 0 END AS new
      FROM {source}))
  GROUP BY {by}, island"""


def _type(df, name):
    return df.filter(F.col("feature") == name)


@query("interval_merge_adjacent", f"WITH {FEATS} {_islands('feats', 'seqname', 1)}")
def interval_merge_adjacent(spark, d):
    return iv.merge_overlapping(views.feats(spark, d), KEYS, adjacent=True)


@query("interval_merge_overlap", f"WITH {FEATS} {_islands('feats', 'seqname', 0)}")
def interval_merge_overlap(spark, d):
    return iv.merge_overlapping(views.feats(spark, d), KEYS)


@query(
    "interval_merge_scores",
    f"""WITH {FEATS}, m AS ({_islands('feats', 'seqname, feature, strand', 1, ', count(*) AS n, sum(score) AS s')})
SELECT seqname, feature, strand, start, "end", n, round(s, 4) AS score FROM m""",
)
def interval_merge_scores(spark, d):
    return iv.merge_features(views.feats(spark, d)).withColumn("score", F.round("score", 4))


@query(
    "interval_merge_weighted_mean",
    f"""WITH {FEATS}, m AS ({_islands('feats', 'seqname, feature', 1, ', count(*) AS n, sum(score * ("end" - start + 1)) / sum("end" - start + 1) AS s')})
SELECT seqname, feature, start, "end", n, round(s, 4) AS score FROM m""",
)
def interval_merge_weighted_mean(spark, d):
    return iv.merge_features(views.feats(spark, d), ("seqname", "feature"), score="mean").withColumn("score", F.round("score", 4))


@query(
    "interval_merge_all",
    f"""WITH {FEATS}, m AS ({_islands('feats', 'seqname', 0, ', sum(score) AS s, min(strand) AS s0, max(strand) AS s1, min(frame) AS f0, max(frame) AS f1')})
SELECT seqname, start, "end", round(s, 4) AS score, CASE WHEN s0 = s1 THEN s0 ELSE '.' END AS strand, CASE WHEN f0 = f1 THEN f0 END AS frame FROM m""",
)
def interval_merge_all(spark, d):
    return iv.merge_all(views.feats(spark, d)).withColumn("score", F.round("score", 4))


PAIRS = """a.seqname = b.seqname AND a.feature = 'purchase' AND b.feature = 'click' AND a.start <= b."end" AND b.start <= a."end\""""


@query(
    "interval_overlap_fragments",
    f"""WITH {FEATS} SELECT a.event_id, a.seqname, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end"
FROM feats a JOIN feats b ON {PAIRS}""",
)
def interval_overlap_fragments(spark, d):
    f = views.feats(spark, d)
    return iv.overlap_fragments(_type(f, "purchase"), _type(f, "click"), width=DAY).select("event_id", "seqname", "start", "end")


COVERED = f"""c AS (SELECT event_id, sum("end" - start + 1) AS covered FROM ({_islands('p', 'event_id', 1)}) GROUP BY event_id),
x AS (SELECT f.*, coalesce(c.covered, 0) AS covered FROM feats f LEFT JOIN c USING (event_id) WHERE feature = 'purchase')"""
PARTS = f"""p AS (SELECT a.event_id, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM feats a JOIN feats b ON {PAIRS})"""


@query("interval_semi_min_overlap", f"""WITH {FEATS}, {PARTS}, {COVERED} SELECT event_id, seqname, start, "end" FROM x WHERE covered >= 3600 AND covered >= 0.5 * ("end" - start + 1)""")
def interval_semi_min_overlap(spark, d):
    f = views.feats(spark, d)
    return iv.overlap_semi(_type(f, "purchase"), _type(f, "click"), "event_id", min_bases=3600, min_fraction=0.5, width=DAY).select("event_id", "seqname", "start", "end")


@query("interval_anti", f"""WITH {FEATS}, {PARTS}, {COVERED} SELECT event_id, seqname, start, "end" FROM x WHERE NOT covered >= 1""")
def interval_anti(spark, d):
    f = views.feats(spark, d)
    return iv.overlap_semi(_type(f, "purchase"), _type(f, "click"), "event_id", anti=True, width=DAY).select("event_id", "seqname", "start", "end")


REGIONS = """regions AS (SELECT seqname, min(start) - 1000 AS start, max("end") + 1000 AS "end" FROM feats GROUP BY seqname)"""


@query(
    "interval_inverse",
    f"""WITH {FEATS}, {REGIONS}, m AS ({_islands('feats', 'seqname', 1)}),
g AS (SELECT m.seqname, coalesce(lag(m."end") OVER w + 1, r.start) AS start, m.start - 1 AS "end" FROM m JOIN regions r USING (seqname) WINDOW w AS (PARTITION BY m.seqname ORDER BY m.start)),
t AS (SELECT m.seqname, max(m."end") + 1 AS start, max(r."end") AS "end" FROM m JOIN regions r USING (seqname) GROUP BY m.seqname)
SELECT * FROM g WHERE start <= "end" UNION ALL SELECT * FROM t WHERE start <= "end\"""",
)
def interval_inverse(spark, d):
    f = views.feats(spark, d)
    regions = f.groupBy("seqname").agg((F.min("start") - 1000).alias("start"), (F.max("end") + 1000).alias("end"))
    return iv.inverse(f, regions)


@query(
    "interval_split",
    f"""WITH {FEATS}, k AS (SELECT *, unnest(generate_series(0, ("end" - start) // 7200)) AS k FROM feats)
SELECT event_id, start + k * 7200 AS start, least("end", start + k * 7200 + 7199) AS "end" FROM k""",
)
def interval_split(spark, d):
    return iv.split_features(views.feats(spark, d), 7200).select("event_id", "start", "end")


@query(
    "interval_split_from_right",
    f"""WITH {FEATS}, k AS (SELECT *, unnest(generate_series(0, ("end" - start) // 7200)) AS k FROM feats), p AS (
SELECT event_id, greatest(start, "end" - k * 7200 - 7199) AS start, "end" - k * 7200 AS "end" FROM k) SELECT * FROM p WHERE "end" - start + 1 = 7200""",
)
def interval_split_from_right(spark, d):
    return iv.split_features(views.feats(spark, d), 7200, from_right=True, drop_short=True).select("event_id", "start", "end")


MERGED_TYPES = f"""a AS ({_islands("(SELECT * FROM feats WHERE feature = 'purchase')", 'seqname', 1)}), b AS ({_islands("(SELECT * FROM feats WHERE feature = 'click')", 'seqname', 1)})"""


@query(
    "feature_bits_and",
    f"""WITH {FEATS}, {MERGED_TYPES} SELECT a.seqname, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start) + 1) AS BIGINT) AS bases
FROM a JOIN b ON a.seqname = b.seqname AND a.start <= b."end" AND b.start <= a."end" GROUP BY a.seqname""",
)
def feature_bits_and(spark, d):
    f = views.feats(spark, d)
    return iv.feature_bits([_type(f, "purchase"), _type(f, "click")]).groupBy("seqname").agg(F.sum(iv.length()).alias("bases"))


@query(
    "feature_bits_or",
    f"""WITH {FEATS}, m AS ({_islands("(SELECT * FROM feats WHERE feature IN ('purchase', 'click'))", 'seqname', 1)})
SELECT seqname, CAST(sum("end" - start + 1) AS BIGINT) AS bases FROM m GROUP BY seqname""",
)
def feature_bits_or(spark, d):
    f = views.feats(spark, d)
    return iv.feature_bits([_type(f, "purchase"), _type(f, "click")], union=True).groupBy("seqname").agg(F.sum(iv.length()).alias("bases"))


@query(
    "introns",
    f"""WITH {FEATS}, n AS (SELECT seqname, feature, "end" + 1 AS start, lead(start) OVER (PARTITION BY seqname, feature ORDER BY start, "end") - 1 AS "end" FROM feats)
SELECT seqname, feature AS grp, start, "end" FROM n WHERE "end" >= start""",
)
def introns(spark, d):
    f = views.feats(spark, d).withColumn("grp", F.col("feature"))
    return iv.introns(f, ("seqname", "grp")).select("seqname", "grp", "start", "end")


@query("group_by_tag", "SELECT regexp_extract(props, '\"k\": ([0-9]+)', 1) AS grp, count(*) AS n, round(sum(value), 4) AS score FROM events GROUP BY 1")
def group_by_tag(spark, d):
    f = views.feats(spark, d).withColumn("attribute", F.regexp_replace("attribute", '[{}":,]', ""))
    return iv.group_by_tag(f, "k").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("group_bounds", f"""WITH {FEATS} SELECT seqname, feature, min(start) AS start, max("end") AS "end", count(*) AS n FROM feats GROUP BY ALL""")
def group_bounds(spark, d):
    return iv.group_bounds(views.feats(spark, d), ("seqname", "feature"))


@query("subset_range", f"""WITH {FEATS} SELECT event_id, start - 1704999999 AS start, "end" - 1704999999 AS "end" FROM feats WHERE start >= 1705000000 AND "end" <= 1705500000""")
def subset_range(spark, d):
    return iv.subset_range(views.feats(spark, d), 1705000000, 1705500000, reindex=True).select("event_id", "start", "end")


@query("subset_overlap", f"""WITH {FEATS} SELECT event_id, start, "end" FROM feats WHERE start <= 1705500000 AND "end" >= 1705000000""")
def subset_overlap(spark, d):
    return iv.subset_overlap(views.feats(spark, d), 1705000000, 1705500000).select("event_id", "start", "end")


@query("add_offset_clip", f"""WITH {FEATS}, o AS (SELECT event_id, start - 1705000000 AS start, "end" - 1705000000 AS "end" FROM feats)
SELECT event_id, greatest(start, 1) AS start, least("end", 500000) AS "end" FROM o WHERE "end" >= 1 AND start <= 500000""")
def add_offset_clip(spark, d):
    return iv.add_offset(views.feats(spark, d), -1705000000, 500000).select("event_id", "start", "end")


@query("reverse_coords", f"""WITH {FEATS} SELECT event_id, 3500000000 - "end" AS start, 3500000000 - start AS "end", CASE strand WHEN '+' THEN '-' ELSE '+' END AS strand FROM feats""")
def reverse_coords(spark, d):
    return iv.reverse_complement(views.feats(spark, d), 1700000000, 1800000000).select("event_id", "start", "end", "strand")


@query("filter_by_type", f"WITH {FEATS} SELECT event_id, feature FROM feats WHERE feature IN ('signup', 'error')")
def filter_by_type(spark, d):
    return iv.filter_by_type(views.feats(spark, d), ["signup", "error"]).select("event_id", "feature")


@query("filter_by_type_exclude", f"WITH {FEATS} SELECT event_id, feature FROM feats WHERE feature NOT IN ('signup', 'error')")
def filter_by_type_exclude(spark, d):
    return iv.filter_by_type(views.feats(spark, d), ["signup", "error"], exclude=True).select("event_id", "feature")


@query("partition_by_type", f"WITH {FEATS} SELECT feature, min(event_id) AS first_seen, count(*) AS n FROM feats GROUP BY feature")
def partition_by_type(spark, d):
    return iv.partition_by_type(views.feats(spark, d), "event_id")


@query(
    "exon_groups",
    f"""WITH {FEATS}, n AS (SELECT *, CASE WHEN lag("end") OVER w IS NULL OR start > lag("end") OVER w + 1 OR strand <> lag(strand) OVER w THEN 1 ELSE 0 END AS new
FROM feats WINDOW w AS (PARTITION BY seqname ORDER BY start, "end", event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY seqname ORDER BY start, "end", event_id ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT seqname, CAST(max(g) AS BIGINT) AS n_groups FROM g GROUP BY seqname""",
)
def exon_groups(spark, d):
    return iv.exon_groups(views.feats(spark, d), KEYS).groupBy("seqname").agg(F.max("exon_grp").alias("n_groups"))


@query("unique_groups")
def unique_groups(spark, d):
    f = views.feats(spark, d).withColumn("grp", F.expr("event_id div 3"))
    return iv.remove_overlaps(f).select("event_id", "seqname", "grp")


@query(
    "threshold_runs",
    """WITH r AS (SELECT user_id, event_id, value, value > 10 AS above, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, above ORDER BY pos) AS run FROM r)
SELECT user_id, min(pos) AS start, max(pos) AS "end", count(*) AS n, round(sum(value), 4) AS score FROM g WHERE above GROUP BY user_id, run""",
)
def threshold_runs(spark, d):
    from pyspark.sql import Window

    from tessera.runtime import table

    e = table(spark, d, "events").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return iv.threshold_runs(e, ("user_id",), "at", "value", 10.0).withColumn("score", F.round("score", 4))


@query(
    "label_positions",
    """WITH promo AS (SELECT 'a' AS feature, 9000 AS s, 9400 AS e, 1 AS cat, 2 AS precedence UNION ALL SELECT 'b', 9200, 9900, 2, 1 UNION ALL SELECT 'c', 9100, 10500, 3, -1),
p AS (SELECT DISTINCT l_shipdate::DATE - DATE '1970-01-01' AS "at" FROM lineitem)
SELECT "at", coalesce((SELECT arg_min(cat, CASE WHEN precedence < 0 THEN 2147483647 ELSE precedence END) FROM promo WHERE p."at" BETWEEN s AND e), 0) AS cat FROM p""",
)
def label_positions(spark, d):
    from tessera.runtime import table

    feats = spark.createDataFrame([("a", 1, 9000, 9400), ("b", 1, 9200, 9900), ("c", 1, 9100, 10500)], "feature string, k int, start long, end long")
    cats = spark.createDataFrame([("a", 1, 2), ("b", 2, 1), ("c", 3, -1)], "feature string, cat int, precedence int")
    days = table(spark, d, "lineitem").select(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01")).cast("long").alias("at")).distinct().withColumn("k", F.lit(1))
    return iv.label_positions(days, feats, cats, ("k",), "at", width=512).select("at", "cat")


@query(
    "run_lengths",
    f"""WITH {views.SYMBOLS}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY seq, sym ORDER BY pos) AS run FROM symbols)
SELECT seq, sym, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM g GROUP BY seq, sym, run""",
)
def run_lengths(spark, d):
    return iv.run_lengths(views.symbols(spark, d), ("seq",), "pos", "sym")


@query(
    "coord_map_asof",
    """WITH s AS (SELECT user_id, ts AS at, value FROM events WHERE event_type = 'signup'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.user_id, s.value AS signup_value FROM e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.at""",
)
def coord_map_asof(spark, d):
    from tessera.runtime import table

    e = table(spark, d, "events")
    marks = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("signup_value"))
    rows = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return iv.asof_position(rows, marks, ("user_id",), "ts", "at", ("signup_value",), bins=F.to_date).select("event_id", "user_id", "signup_value")
