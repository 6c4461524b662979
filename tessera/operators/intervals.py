"""Interval algebra over feature rows.

A feature frame has seqname, feature, start, end (1-based, both ends included), score, strand, frame and attribute;
most operators need only seqname, start and end and pass other columns on. Overlap tests include both ends.

Joins meet in position bins: a row is sent once to every bin that it touches, and a pair is kept only in the first bin
that both touch, so nothing is compared across far positions and no pair comes twice. Merging and runs work in two levels:
inside (seqname, bin) first; what goes on over a bin's border is then told by one row for each bin. A seqname that
holds a third of all rows is thus spread over its bins, even where nothing merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import numbered, stage

BIN = 1 << 17

Keys = Sequence[str]


def length(start: str = "start", end: str = "end") -> Column:
    return F.col(end) - F.col(start) + 1


# -- filters and projections -------------------------------------------------------------------------------------------


def filter_by_type(feats: DataFrame, types: Iterable[str], exclude: bool = False) -> DataFrame:
    """Rows of the given feature types, or all others; the rejected rows are filter_by_type(..., not exclude)."""
    hit = F.coalesce(F.col("feature").isin(list(types)), F.lit(False))
    return feats.filter(~hit if exclude else hit)


def filter_by_group(feats: DataFrame, groups: DataFrame, group: str = "grp") -> DataFrame:
    """Rows whose group is in another frame."""
    return feats.join(groups.select(group).distinct(), group, "left_semi")


def subset_range(feats: DataFrame, start: int, end: int, reindex: bool = False) -> DataFrame:
    """Features fully inside [start, end]; reindex makes `start` position 1."""
    out = feats.filter((F.col("start") >= start) & (F.col("end") <= end))
    return shift(out, 1 - start) if reindex else out


def subset_overlap(feats: DataFrame, start: int, end: int) -> DataFrame:
    return feats.filter((F.col("start") <= end) & (F.col("end") >= start))


def shift(feats: DataFrame, offset: int) -> DataFrame:
    return feats.withColumn("start", F.col("start") + offset).withColumn("end", F.col("end") + offset)


def add_offset(feats: DataFrame, offset: int, most: int | None = None) -> DataFrame:
    """Shifted rows; those wholly outside [1, most] go and partial ones are cut at its ends."""
    out = shift(feats, offset).filter(F.col("end") >= 1)
    if most is not None:
        out = out.filter(F.col("start") <= most).withColumn("end", F.least("end", F.lit(most)))
    return out.withColumn("start", F.greatest("start", F.lit(1)))


def reverse_complement(feats: DataFrame, start: int, end: int) -> DataFrame:
    """Coordinates mirrored in [start, end], strands flipped."""
    out = feats.withColumn("_s", start + end - F.col("end")).withColumn("end", start + end - F.col("start")).withColumn("start", F.col("_s")).drop("_s")
    return out.withColumn("strand", F.when(F.col("strand") == "+", "-").when(F.col("strand") == "-", "+").otherwise(F.col("strand"))) if "strand" in feats.columns else out


def reverse_strand_only(feats: DataFrame, by: Keys = ("seqname",)) -> DataFrame:
    """Per group: no plus row and at least one minus row."""
    return feats.groupBy(*by).agg((F.max((F.col("strand") == "+").cast("int")) == 0).alias("_p"), (F.max((F.col("strand") == "-").cast("int")) == 1).alias("_m")).select(*by, (F.col("_p") & F.col("_m")).alias("reverse_only"))


def sort_features(feats: DataFrame) -> DataFrame:
    """By start, then end, inside range partitions of (seqname, start)."""
    return feats.orderBy("seqname", "start", "end")


def partition_by_type(feats: DataFrame, order: str) -> DataFrame:
    """A row for each type with its count, in the order of first sight."""
    return feats.groupBy("feature").agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n")).orderBy("first_seen")


def rank_seqnames(feats: DataFrame) -> DataFrame:
    """Dictionary of seqnames, numbered from 0."""
    return numbered(feats.select("seqname").distinct(), [F.col("seqname")], "seq_id")


# -- joins -------------------------------------------------------------------------------------------------------------


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.expr(f"floor({start} / {width})"), F.expr(f"floor({end} / {width})"))))


def overlap_pairs(left: DataFrame, right: DataFrame, by: Keys = ("seqname",), width: int = BIN) -> DataFrame:
    """All pairs of rows that share a position; right's columns are prefixed with r_ (keys too)."""
    a = _binned(left, "start", "end", width)
    b = _binned(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), "r_start", "r_end", width).withColumnRenamed("_bin", "_rbin")
    on = [F.col(k) == F.col(f"r_{k}") for k in by] + [F.col("_bin") == F.col("_rbin"), F.col("start") <= F.col("r_end"), F.col("r_start") <= F.col("end")]
    joined = a.join(b, on)
    return joined.filter(F.col("_bin") == F.expr(f"floor(greatest(start, r_start) / {width})")).drop("_bin", "_rbin")


def overlap_fragments(left: DataFrame, right: DataFrame, by: Keys = ("seqname",), min_bases: int = 1, min_fraction: float = -1.0, width: int = BIN) -> DataFrame:
    """The common part of each pair, as a row of left with new ends; the fraction is of the right row's length."""
    pairs = overlap_pairs(left, right, by, width)
    common = F.least("end", "r_end") - F.greatest("start", "r_start") + 1
    kept = pairs.filter(_enough(common, F.col("r_end") - F.col("r_start") + 1, min_bases, min_fraction))
    return kept.withColumn("_s", F.greatest("start", "r_start")).withColumn("end", F.least("end", "r_end")).withColumn("start", F.col("_s")).select(*left.columns)


def _enough(common: Column, whole: Column, min_bases: int, min_fraction: float) -> Column:
    if min_bases <= 0 and min_fraction <= 0:
        raise ValueError("one of the two thresholds must be positive")
    test = F.lit(True)
    if min_bases >= 0:
        test = test & (common >= min_bases)
    if min_fraction >= 0:
        test = test & (common >= min_fraction * whole)
    return test


def overlap_lengths(left: DataFrame, right: DataFrame, row: str, by: Keys = ("seqname",), width: int = BIN) -> DataFrame:
    """`row` (an identifier of left rows) and covered: the length of the UNION of its overlaps."""
    pairs = overlap_pairs(left.select(row, *by, "start", "end"), right.select(*by, "start", "end"), by, width)
    parts = pairs.select(F.col(row), F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))
    merged = merge_overlapping(parts, by=(row,), adjacent=True)
    return merged.groupBy(row).agg(F.sum(length()).alias("covered"))


def overlap_semi(left: DataFrame, right: DataFrame, row: str, by: Keys = ("seqname",), min_bases: int = 1, min_fraction: float = -1.0, anti: bool = False, width: int = BIN) -> DataFrame:
    """Rows of left whose overlaps' union reaches both thresholds (or, with anti, does not); the fraction is of left's length."""
    covered = overlap_lengths(left, right, row, by, width).withColumnRenamed(row, "_row")
    joined = left.join(covered, F.col(row) == F.col("_row"), "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    test = _enough(F.col("covered"), length(), min_bases, min_fraction)
    return joined.filter(~test if anti else test).select(*left.columns)


def inverse(feats: DataFrame, regions: DataFrame, by: Keys = ("seqname",)) -> DataFrame:
    """The parts of regions that no feature covers. A seqname of features without a region is an error of the caller: its rows have no place and give none."""
    covered = stage(merge_overlapping(overlap_fragments(feats.select(*by, "start", "end"), regions.select(*by, "start", "end"), by), by, adjacent=True), "covered")
    w = Window.partitionBy(*[f"r_{k}" for k in by], "r_start", "r_end").orderBy("start")
    inside = overlap_pairs(covered, regions.select(*by, "start", "end"), by)
    gaps = inside.withColumn("_prev", F.lag("end").over(w)).withColumn("_next", F.lead("start").over(w))
    before = gaps.select(*by, F.coalesce(F.col("_prev") + 1, F.col("r_start")).alias("start"), (F.col("start") - 1).alias("end"))
    after = gaps.filter("_next is null").select(*by, (F.col("end") + 1).alias("start"), F.col("r_end").alias("end"))
    return before.unionByName(after).filter("start <= end").unionByName(uncovered_regions(regions, covered, by))


def uncovered_regions(regions: DataFrame, covered: DataFrame, by: Keys) -> DataFrame:
    """Regions that nothing covers at all."""
    met = overlap_pairs(regions.select(*by, "start", "end"), covered, by).select(*by, "start", "end").distinct()
    return regions.select(*by, "start", "end").join(met, [*by, "start", "end"], "left_anti")


def asof_position(rows: DataFrame, marks: DataFrame, by: Keys, at: str, mark_at: str, values: Sequence[str], strict: bool = False, bins: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each row with the values of the last mark at or before it (null if none), by a sort of the union.

    bins: a function that maps positions to bins in their order (a day of a time, say). A key's rows are then sorted
    bin by bin, and each bin gets the last mark of the bins before it, so a key with very many rows is no task's alone.
    """
    left = rows.select("*", F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast("boolean").alias("_mark"), *[F.lit(None).cast(marks.schema[v].dataType).alias(f"_v_{v}") for v in values])
    filler = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in by]
    right = marks.select(*by, *filler, F.col(mark_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.lit(True).alias("_mark"), *[F.col(v).alias(f"_v_{v}") for v in values])
    both = left.unionByName(right.select(*left.columns)).withColumn("_bin", F.lit(0) if bins is None else bins(F.col("_at")))
    mark = F.when(F.col("_mark"), F.struct(*[f"_v_{v}" for v in values]))
    w = Window.partitionBy(*by, "_bin").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last(mark, ignorenulls=True).over(w)).filter(F.col("_mark").isNull())
    if bins is not None:
        last = both.groupBy(*by, "_bin").agg(F.max_by(mark, F.when(F.col("_mark"), F.col("_at"))).alias("_last"))
        earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select(*by, "_bin", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
        found = found.join(carried, [*by, "_bin"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select(*rows.columns, *[F.col("_found")[f"_v_{v}"].alias(v) for v in values])


# -- merging and grouping ----------------------------------------------------------------------------------------------


def _islands(df: DataFrame, by: Keys, gap: int, aggs: list[Column], bounds: tuple[str, str] = ("start", "end")) -> DataFrame:
    start, end = bounds
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    flagged = df.withColumn("_new", new)
    numbered = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), *aggs).drop("_island")


def _with(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the further columns of a frame that has a row for each of its keys; null keys meet too."""
    right = other.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return df.join(right, same, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def _begun_before(flagged: DataFrame, by: Keys, name: str) -> DataFrame:
    """by, _b and the place where the last new one of the earlier bins began."""
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = flagged.groupBy(*by, "_b").agg(F.max(F.when(F.col("_new"), F.col("start"))).alias("_last"))
    return last.select(*by, "_b", F.max("_last").over(earlier).alias(name))


def _merged(rows: DataFrame, by: Keys, gap: int, first: list[Column], again: list[Column], width: int) -> DataFrame:
    """Islands of rows, found inside (key, bin) and then joined over the bins' borders.

    A bin's islands that begin within the reach of all earlier bins belong to the island that reaches so far, which is the
    last one that began before. So only one row for each bin is sorted by key, and a key's rows never come to one task.
    """
    local = stage(_islands(rows.withColumn("_b", F.expr(f"floor(start / {width})")), [*by, "_b"], gap, first), "islands")
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    reach = local.groupBy(*by, "_b").agg(F.max("end").alias("_end")).select(*by, "_b", F.max("_end").over(earlier).alias("_reach"))
    flagged = _with(local, reach, [*by, "_b"]).withColumn("_new", F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap))
    of = F.when(F.col("_new"), F.col("start")).otherwise(F.col("_from"))
    met = _with(flagged, _begun_before(flagged, by, "_from"), [*by, "_b"]).withColumn("_island", of)
    return met.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *again).drop("_island")


def merge_overlapping(feats: DataFrame, by: Keys = ("seqname",), adjacent: bool = False, width: int = BIN) -> DataFrame:
    """by, start, end of the islands; adjacent rows merge only if asked for."""
    return _merged(feats.select(*by, "start", "end"), by, 1 if adjacent else 0, [], [], width)


def merge_features(feats: DataFrame, by: Keys = ("seqname", "feature", "strand"), adjacent: bool = True, score: str = "sum", width: int = BIN) -> DataFrame:
    """Islands with their number of rows and a merged score: sum, min, max or mean (weighted by length).

    Null scores are left out of sums and means; the score is null only where all are.
    """
    part = feats.select(*by, "start", "end", F.col("score").cast("double").alias("score"))
    weight = F.when(F.col("score").isNotNull(), length())
    first = [F.count(F.lit(1)).alias("n"), F.sum("score").alias("_sum"), F.min("score").alias("_min"), F.max("score").alias("_max"), F.sum(F.col("score") * length()).alias("_ws"), F.sum(weight).alias("_w")]
    again = [F.sum("n").alias("n"), F.sum("_sum").alias("_sum"), F.min("_min").alias("_min"), F.max("_max").alias("_max"), F.sum("_ws").alias("_ws"), F.sum("_w").alias("_w")]
    merged = _merged(part, by, 1 if adjacent else 0, first, again, width)
    value = {"sum": F.col("_sum"), "min": F.col("_min"), "max": F.col("_max"), "mean": F.col("_ws") / F.col("_w")}[score]
    return merged.select(*by, "start", "end", "n", value.alias("score"))


def merge_all(feats: DataFrame, width: int = BIN) -> DataFrame:
    """Overlapping rows of a seqname merged whatever their strand: differing strands become '.', differing frames null."""
    part = feats.select("seqname", "start", "end", "score", "strand", "frame")
    aggs = [F.sum("score").alias("score"), F.min("strand").alias("_s0"), F.max("strand").alias("_s1"), F.min("frame").alias("_f0"), F.max("frame").alias("_f1")]
    again = [F.sum("score").alias("score"), F.min("_s0").alias("_s0"), F.max("_s1").alias("_s1"), F.min("_f0").alias("_f0"), F.max("_f1").alias("_f1")]
    merged = _merged(part, ["seqname"], 0, aggs, again, width)
    return merged.select("seqname", "start", "end", "score", F.when(F.col("_s0") == F.col("_s1"), F.col("_s0")).otherwise(".").alias("strand"), F.when(F.col("_f0") == F.col("_f1"), F.col("_f0")).alias("frame"))


def feature_bits(sets: Sequence[DataFrame], union: bool = False, by: Keys = ("seqname",)) -> DataFrame:
    """Rows (by, start, end) that any (union) or all of the sets cover."""
    merged = [merge_overlapping(s, by, adjacent=True) for s in sets]
    out = merged[0]
    for m in merged[1:]:
        out = out.unionByName(m) if union else overlap_fragments(out, m, by)
    return merge_overlapping(out, by, adjacent=True)


def group_by_tag(feats: DataFrame, tag: str, name: str = "grp") -> DataFrame:
    """Adds the value of a tag in the attribute (`tag "value"` or `tag value`), empty where it is missing."""
    return feats.withColumn(name, F.regexp_extract(F.coalesce("attribute", F.lit("")), rf'(?:^|;|\s){tag}\s+"?([^";]+)"?', 1))


def group_bounds(feats: DataFrame, by: Keys) -> DataFrame:
    return feats.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def exon_groups(feats: DataFrame, by: Keys, name: str = "exon_grp") -> DataFrame:
    """Numbers runs of abutting rows of one strand inside each group: a new run starts after a gap or where the strand changes."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    new = F.lag("end").over(w).isNull() | (F.col("start") > F.lag("end").over(w) + 1) | (F.col("strand") != F.lag("strand").over(w))
    return feats.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def remove_overlaps(feats: DataFrame, group: str = "grp", by: Keys = ("seqname",)) -> DataFrame:
    """Greedy choice among overlapping groups: a newcomer replaces all keepers that it overlaps only if its score (sum, else span) is greater than theirs together.

    Only groups of one connected cluster of spans can meet, so clusters are cut first by islands and each is resolved alone.
    """
    spans = feats.groupBy(*by, group).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.coalesce(F.sum("score"), (F.max("end") - F.min("start") + 1).cast("double")).alias("score"))
    w = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    clustered = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("_cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    @F.pandas_udf("array<int>")
    def resolve(starts: pd.Series, ends: pd.Series, scores: pd.Series) -> pd.Series:
        """The places of the kept groups of each cluster; a batch holds many clusters."""
        out = []
        for cluster in zip(starts, ends, scores):
            kept: list = []
            for i, (start, end, score) in enumerate(zip(*cluster)):
                hit = [k for k in kept if k[1] <= end and start <= k[2]]
                if not hit or score > sum(k[3] for k in hit):
                    kept = [k for k in kept if k not in hit] + [(i, start, end, score)]
            out.append([k[0] for k in kept])
        return pd.Series(out)

    packed = clustered.groupBy(*by, "_cluster").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col(group).alias("grp"), "score"))).alias("_x"))
    places = packed.select(*by, "_x", F.explode(resolve("_x.start", "_x.end", "_x.score")).alias("_i"))
    chosen = places.select(*by, F.get("_x.grp", F.col("_i")).alias(group))
    return feats.join(chosen.select(*by, group), [*by, group], "left_semi")


# -- positional --------------------------------------------------------------------------------------------------------


def split_features(feats: DataFrame, most: int, from_right: bool = False, drop_short: bool = False) -> DataFrame:
    """Pieces of at most `most` bases from the left (or right) end; the short remainder can be dropped."""
    pieces = feats.withColumn("_k", F.explode(F.sequence(F.lit(0), F.expr(f"(end - start) div {most}"))))
    if from_right:
        pieces = pieces.withColumn("_e", F.col("end") - F.col("_k") * most).withColumn("start", F.greatest("start", F.col("_e") - (most - 1))).withColumn("end", F.col("_e")).drop("_e")
    else:
        pieces = pieces.withColumn("_s", F.col("start") + F.col("_k") * most).withColumn("end", F.least("end", F.col("_s") + (most - 1))).withColumn("start", F.col("_s")).drop("_s")
    return (pieces.filter(length() == most) if drop_short else pieces).drop("_k")


def introns(feats: DataFrame, by: Keys) -> DataFrame:
    """The gaps between consecutive rows of a group."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    out = feats.withColumn("_next", F.lead("start").over(w)).filter(F.col("_next") > F.col("end") + 1)
    return out.withColumn("start", F.col("end") + 1).withColumn("end", F.col("_next") - 1).drop("_next").withColumn("feature", F.lit("intron"))


def utrs(exons: DataFrame, cds: DataFrame, by: Keys) -> DataFrame:
    """Exon parts outside the span of a group's coding rows: 5'UTR and 3'UTR by strand."""
    span = cds.groupBy(*by).agg(F.min("start").alias("_cs"), F.max("end").alias("_ce"))
    met = exons.join(span, list(by))
    left = met.filter("start < _cs").withColumn("end", F.least("end", F.col("_cs") - 1)).withColumn("feature", F.when(F.col("strand") == "-", "3'UTR").otherwise("5'UTR"))
    right = met.filter("end > _ce").withColumn("start", F.greatest("start", F.col("_ce") + 1)).withColumn("feature", F.when(F.col("strand") == "-", "5'UTR").otherwise("3'UTR"))
    return left.unionByName(right).drop("_cs", "_ce")


def signals(cds: DataFrame, by: Keys) -> DataFrame:
    """Start and stop codons and splice sites at the ends of a group's coding rows."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    rows = cds.withColumn("_first", F.lag("start").over(w).isNull()).withColumn("_last", F.lead("start").over(w).isNull())
    minus = F.col("strand") == "-"

    def at(test: Column, start: Column, end: Column, name: Column) -> DataFrame:
        return rows.filter(test).withColumn("_s", start).withColumn("end", end).withColumn("start", F.col("_s")).withColumn("feature", name).drop("_s", "_first", "_last")

    return (
        at(F.col("_first"), F.col("start"), F.col("start") + 2, F.when(minus, "stop_codon").otherwise("start_codon"))
        .unionByName(at(F.col("_last"), F.col("end") - 2, F.col("end"), F.when(minus, "start_codon").otherwise("stop_codon")))
        .unionByName(at(~F.col("_last"), F.col("end") + 1, F.col("end") + 2, F.when(minus, "3'splice").otherwise("5'splice")))
        .unionByName(at(~F.col("_first"), F.col("start") - 2, F.col("start") - 1, F.when(minus, "5'splice").otherwise("3'splice")))
    )


def threshold_runs(rows: DataFrame, by: Keys, at: str, value: str, limit: float, step: int | None = 1, width: int = BIN) -> DataFrame:
    """Runs of consecutive rows with value > limit: start, end, n and the SUM of values as the score.

    step: positions count as consecutive if they differ by it; None: any next row of the key does.
    """
    return runs_where(rows, by, at, F.col(value) > limit, F.col(value), step, width)


def runs_where(rows: DataFrame, by: Keys, at: str, test: Column, value: Column, step: int | None = 1, width: int = BIN) -> DataFrame:
    """Runs of consecutive rows that pass a test (null fails): start, end, n and the sum of their values as the score."""
    tagged = rows.select(*by, F.col(at).alias("start"), F.col(at).alias("end"), F.lit(1).cast("long").alias("n"), value.alias("score"), F.coalesce(test, F.lit(False)).alias("_label"))
    return _runs(tagged, by, step, ["n", "score"], width).filter("_label").drop("_label")


def _runs(tagged: DataFrame, by: Keys, step: int | None, sums: list[str], width: int) -> DataFrame:
    """Neighbouring rows (start, end) of one _label made one, where their positions are consecutive, with sums of columns.

    Runs are found inside (key, bin) first. The first one of a bin may go on from the last one of the bin before; it then belongs to
    the last run that began in an earlier bin, so again only a row for each bin is sorted by key.
    """
    added = [F.sum(c).alias(c) for c in sums]
    w = Window.partitionBy(*by, "_b").orderBy("start")

    def apart(label: Column, end: Column) -> Column:
        other = ~label.eqNullSafe(F.col("_label"))
        return other if step is None else other | (F.col("start") - end > step)

    first = F.row_number().over(w) == 1
    binned = tagged.withColumn("_b", F.expr(f"floor(start / {width})"))
    numbered = binned.withColumn("_n", (first | apart(F.lag("_label").over(w), F.lag("end").over(w))).cast("int")).withColumn("_run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = stage(numbered.groupBy(*by, "_b", "_label", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *added).drop("_run"), "runs")
    ends = local.groupBy(*by, "_b").agg(F.min("start").alias("_first"), F.max_by(F.struct("_label", "end"), "start").alias("_last"))
    before = ends.select(*by, "_b", "_first", F.lag("_last").over(Window.partitionBy(*by).orderBy("_b")).alias("_before"))
    new = (F.col("start") != F.col("_first")) | F.col("_before").isNull() | apart(F.col("_before._label"), F.col("_before.end"))
    flagged = _with(local, before, [*by, "_b"]).withColumn("_new", new)
    met = _with(flagged, _begun_before(flagged, by, "_from"), [*by, "_b"]).withColumn("_run", F.when(F.col("_new"), F.col("start")).otherwise(F.col("_from")))
    return met.groupBy(*by, "_label", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *added).drop("_run")


def label_positions(positions: DataFrame, feats: DataFrame, categories: DataFrame, by: Keys, at: str, width: int = BIN) -> DataFrame:
    """Each position with the category of the covering feature of least precedence (0 where none covers it).

    categories: feature, cat and precedence; a negative precedence means none, which loses to any other.
    """
    weighed = feats.join(categories, "feature").withColumn("_rank", F.when(F.col("precedence") < 0, F.lit(2**31 - 1)).otherwise(F.col("precedence")))
    points = positions.withColumn("start", F.col(at)).withColumn("end", F.col(at))
    met = overlap_pairs(points, weighed.select(*by, "start", "end", "cat", "_rank"), by, width)
    best = met.groupBy(*by, at).agg(F.min(F.struct("r__rank", "r_cat")).alias("_best"))
    labelled = best.select(*by, at, F.col("_best.r_cat").alias("cat"))
    return positions.join(labelled, [*by, at], "left").withColumn("cat", F.coalesce("cat", F.lit(0)))


def run_lengths(rows: DataFrame, by: Keys, at: str, label: str, width: int = BIN) -> DataFrame:
    """Run-length encoding of labels along a key: label, start, end, n."""
    tagged = rows.select(*by, F.col(label).alias("_label"), F.col(at).alias("start"), F.col(at).alias("end"), F.lit(1).cast("long").alias("n"))
    return _runs(tagged, by, None, ["n"], width).select(*by, F.col("_label").alias(label), "start", "end", "n")


def fix_start_stop(feats: DataFrame, by: Keys) -> DataFrame:
    """Per group: coding rows are extended over an abutting start codon and shrunk before a stop codon."""
    codons = feats.filter(F.col("feature").isin("start_codon", "stop_codon")).groupBy(*by).agg(
        *[f(F.when(F.col("feature") == kind, F.col(side))).alias(f"_{kind[:5].strip('_')}_{side}") for kind in ("start_codon", "stop_codon") for f, side in ((F.min, "start"), (F.max, "end"))]
    )
    met = feats.join(codons, list(by), "left")
    is_cds, minus = F.col("feature") == "CDS", F.col("strand") == "-"
    start = F.when(is_cds & ~minus & (F.col("_start_end") + 1 == F.col("start")), F.col("_start_start")).when(is_cds & minus & (F.col("_stop_start") == F.col("start")), F.col("_stop_end") + 1).otherwise(F.col("start"))
    end = F.when(is_cds & minus & (F.col("_start_start") - 1 == F.col("end")), F.col("_start_end")).when(is_cds & ~minus & (F.col("_stop_end") == F.col("end")), F.col("_stop_start") - 1).otherwise(F.col("end"))
    return met.withColumn("_s", start).withColumn("end", end).withColumn("start", F.col("_s")).select(*feats.columns)


def absorb_helpers(feats: DataFrame, primary: Iterable[str], helpers: Iterable[str], by: Keys) -> DataFrame:
    """Primary rows extended over helper rows of the group that abut or overlap them on either side; no row is made or lost."""
    help_ = feats.filter(F.col("feature").isin(list(helpers))).select(*by, F.col("start").alias("_hs"), F.col("end").alias("_he"))
    left = help_.select(*by, (F.col("_he") + 1).alias("start"), F.col("_hs").alias("_new_start")).groupBy(*by, "start").agg(F.min("_new_start").alias("_new_start"))
    right = help_.select(*by, (F.col("_hs") - 1).alias("end"), F.col("_he").alias("_new_end")).groupBy(*by, "end").agg(F.max("_new_end").alias("_new_end"))
    is_primary = F.col("feature").isin(list(primary))
    met = feats.join(left, [*by, "start"], "left").join(right, [*by, "end"], "left")
    grown = F.col("start") - F.when(is_primary, F.coalesce("_new_start", "start")).otherwise(F.col("start"))
    frame = F.when(F.col("frame").isNotNull() & (F.col("strand") != "-"), F.pmod(F.col("frame") - grown, F.lit(3))).otherwise(F.col("frame")) if "frame" in feats.columns else None
    out = met.withColumn("_s", F.when(is_primary, F.coalesce("_new_start", "start")).otherwise(F.col("start"))).withColumn("_e", F.when(is_primary, F.coalesce("_new_end", "end")).otherwise(F.col("end")))
    if frame is not None:
        out = out.withColumn("frame", frame)
    return out.withColumn("start", F.col("_s")).withColumn("end", F.col("_e")).select(*feats.columns)


def add_gene_id(feats: DataFrame, group: str = "grp") -> DataFrame:
    """Puts the group before the attribute as a gene_id."""
    return feats.withColumn("attribute", F.concat(F.lit('gene_id "'), F.col(group), F.lit('" ; '), F.coalesce("attribute", F.lit(""))))
