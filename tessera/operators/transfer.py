"""Positions and features carried through alignments: gapless segments of pairs, and blocks of many sequences.

Segments are (by, block, qs, qe, ts, te): query and target ends, 1-based and inclusive, of equal lengths. Features meet them in
position bins, so a chromosome with most of both is spread over its bins; what is left of a feature in a block is put
together by one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.intervals import BIN, asof_position, overlap_pairs
from tessera.sources.alignments import maf_columns


def transfer_features(feats: DataFrame, segments: DataFrame, row: str, by: Sequence[str] = ("seqname",), width: int = BIN) -> DataFrame:
    """A row for each block in which a feature has aligned bases: the feature with start and end in the target, and block.

    Ends between segments move to the nearest aligned base inside the feature, so insertions of the target between
    segments of a block are covered; a feature without aligned bases has no row. row: a column that tells features apart.
    """
    pieces = overlap_pairs(feats, segments.select(*by, F.col("qs").alias("start"), F.col("qe").alias("end"), "block", "ts"), by, width)
    inside = lambda at: F.col("r_ts") + at - F.col("r_start")
    cut = pieces.select(
        F.col(row), F.col("r_block").alias("block"), inside(F.greatest("start", "r_start")).alias("_a"), inside(F.least("end", "r_end")).alias("_b")
    )
    met = cut.groupBy(row, "block").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    kept = [F.col("_a").alias("start") if c == "start" else F.col("_b").alias("end") if c == "end" else F.col(c) for c in feats.columns]
    return feats.join(met, row).select(*kept, "block")


def target_positions(points: DataFrame, segments: DataFrame, at: str, by: Sequence[str] = ("seqname",), right: bool = False, bins: Callable[[Column], Column] | None = None) -> DataFrame:
    """points with target: their aligned base; between segments the last aligned base before (right: the next one after), null without one.

    Also null where the segments around a point are in the other order in the target. Segments of a key don't overlap.
    """
    marks = segments.withColumn("_qs", F.col("qs")).withColumn("_minus", -F.col("qe"))
    before = asof_position(points, marks, by, at, "_qs", ["qs", "qe", "ts", "te"], bins=bins)
    named = before.select(*points.columns, *[F.col(c).alias(f"_{c}") for c in ("qs", "qe", "ts", "te")], (-F.col(at)).alias("_back"))
    both = asof_position(named, marks.select(*by, F.col("_minus"), F.col("ts").alias("_next")), by, "_back", "_minus", ["_next"], bins=bins)
    hit = F.col(at) <= F.col("_qe")
    between = F.when(F.col("_next") >= F.coalesce("_te", F.lit(0)), F.col("_next")) if right else F.when(F.col("_next").isNull() | (F.col("_next") >= F.col("_te")), F.col("_te"))
    return both.select(*points.columns, F.when(hit, F.col("_ts") + F.col(at) - F.col("_qs")).otherwise(between).alias("target"))


def unsorted_columns(maf: DataFrame, reference: str, names: Sequence[str]) -> DataFrame:
    """pos and col of blocks in any order that may overlap in the reference: each position is the first block's that has it.

    Places of the reference are told by starts and numbers of bases, so the first blocks are known before any text moves, and
    only blocks that are first somewhere are spelled.
    """
    bases = F.length(F.translate("text", "-", ""))
    places = maf.filter(F.col("seq") == reference).filter(bases > 0).select("block", F.explode(F.sequence(F.col("start") + 1, F.col("start") + bases)).alias("pos"))
    first = places.groupBy("pos").agg(F.min("block").alias("block")).select("block").distinct()
    each = maf_columns(maf.join(first.hint("merge"), "block", "left_semi"), reference, names)  # estimates don't see exploded rows: no broadcast
    return each.groupBy("pos").agg(F.min_by("col", F.struct("block", "at")).alias("col"))


def cut_blocks(maf: DataFrame, reference: str, feats: DataFrame, row: str, width: int = BIN) -> DataFrame:
    """Blocks cut to features of the reference (seqname: its src; 1-based), with the feature's row: one block for each that both share."""
    ref = maf.filter(F.col("seq") == reference).select("block", F.col("src").alias("seqname"), (F.col("start") + 1).alias("start"), (F.col("start") + F.col("size")).alias("end"), F.col("text").alias("_ref"))
    met = overlap_pairs(ref, feats.select("seqname", "start", "end", row), ("seqname",), width)
    bases = F.expr("filter(sequence(1, length(_ref)), i -> substr(_ref, i, 1) <> '-')")
    place = lambda at: F.element_at(bases, (at - F.col("start") + 1).cast("int"))
    ends = met.select("block", F.col(f"r_{row}").alias(row), place(F.greatest("start", "r_start")).alias("_lo"), place(F.least("end", "r_end")).alias("_hi"))
    cut = maf.join(ends, "block")
    count = lambda s: F.length(F.translate(s, "-", "")).cast("long")
    text = F.substr("text", F.col("_lo"), F.col("_hi") - F.col("_lo") + 1)
    before = F.substr("text", F.lit(1), F.col("_lo") - 1)
    return cut.select(row, *[(F.col("start") + count(before)).alias("start") if c == "start" else count(text).alias("size") if c == "size" else text.alias("text") if c == "text" else F.col(c) for c in maf.columns])
