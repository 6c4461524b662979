"""Columns of aligned sequences as distinct tuples with counts.

An alignment is a long frame (aln, pos, col) with one character per sequence in col. Counting distinct columns turns
millions of positions into few tuples; expensive functions are then applied to the tuples and joined back. All counting
is a plain partial aggregation on the tuple string.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import numbered

GAP = "-"
MISSING = "*N"


def assemble(rows: DataFrame, names: Sequence[str], by: Sequence[str] = ("aln",), fill: str = "*") -> DataFrame:
    """(by, pos, col) from a long frame (by, pos, seq, ch), sequences in the order of names, absent ones filled."""
    picked = rows.groupBy(*by, "pos").agg(F.map_from_entries(F.collect_list(F.struct("seq", "ch"))).alias("_m"))
    return picked.select(*by, "pos", F.concat(*[F.coalesce(F.col("_m")[n], F.lit(fill)) for n in names]).alias("col"))


def contexts(columns: DataFrame, k: int, by: Sequence[str] = ("aln",), sep: str = "", overlapping: bool = True) -> DataFrame:
    """Tuples of k neighbouring columns, named by their last one; the first k - 1 of a sequence are padded with missing columns."""
    if k == 1:
        return columns.withColumn("tuple", F.col("col"))
    from tessera.operators.binned import bin_of, looking_back, own_rows, running

    both, w = looking_back(columns, by, "pos", k - 1)
    pad = F.repeat(F.lit("*"), F.length("col"))
    parts = [F.coalesce(F.lag("col", i).over(w), pad) for i in range(k - 1, 0, -1)] + [F.col("col")]
    out = own_rows(both.withColumn("tuple", F.concat_ws(sep, *parts)))
    return out if overlapping else running(out, by, ["pos"], {"_r": F.lit(1)}, bin_of(out, "pos")).filter(F.col("_r") % k == 0).drop("_r")


def tuple_counts(tuples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tuples.groupBy(*by, "tuple").agg(F.count(F.lit(1)).alias("cnt"))


def tuple_counts_by_category(tuples: DataFrame, category: str = "cat") -> DataFrame:
    """Counts for each (tuple, category) and, with a null category, in all: a rollup over the category."""
    return tuples.rollup("tuple", category).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("tuple").isNotNull())


def index_tuples(counts: DataFrame) -> DataFrame:
    """Numbers the distinct tuples from 0 by frequency and name."""
    return numbered(counts, [F.col("cnt").desc(), F.col("tuple")], "tuple_id")


def apply_once(rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distinct keys -> compute (key plus new columns) -> joined back to all rows."""
    return rows.join(compute(rows.select(key).distinct()), key, "left")


def aggregate_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Adds up counts of several tuple tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("tuple").agg(F.sum("cnt").alias("cnt"))


def recount(counts: DataFrame, tuple_: Column) -> DataFrame:
    """Counts after a change to the tuples that may make some equal."""
    return counts.select(tuple_.alias("tuple"), "cnt").groupBy("tuple").agg(F.sum("cnt").alias("cnt"))


def collapse_missing(counts: DataFrame, gaps_too: bool = False, missing: str = "N") -> DataFrame:
    """All missing characters (and gaps, if asked for) become the default one."""
    return recount(counts, F.translate("tuple", missing + (GAP if gaps_too else ""), "*" * (len(missing) + gaps_too)))


def complement(col: Column) -> Column:
    return F.translate(col, "ACGTacgt", "TGCAtgca")


def reverse_complement_tuples(counts: DataFrame, rows: int, k: int = 1) -> DataFrame:
    """Columns complemented and, inside a tuple of k columns, in reverse order."""
    parts = [F.substring("tuple", 1 + i * rows, rows) for i in range(k - 1, -1, -1)]
    return recount(counts, complement(F.concat(*parts)))


def take_rows(col: Column, keep: Sequence[int]) -> Column:
    """The characters at 0-based places, in that order; -1 gives a missing one."""
    return F.concat(*[F.lit("*") if i < 0 else F.substring(col, i + 1, 1) for i in keep])


def sub_alignment(columns: DataFrame, keep: Sequence[int] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows and a 0-based half-open column range (positions are 1-based)."""
    out = columns
    if start is not None:
        out = out.filter(F.col("pos") > start)
    if end is not None:
        out = out.filter(F.col("pos") <= end)
    return out if keep is None else out.withColumn("col", take_rows(F.col("col"), keep))


def n_informative(col: Column) -> Column:
    """Symbols that are neither gap nor missing."""
    return F.length(F.translate(col, GAP + MISSING, ""))


def is_informative(col: Column) -> Column:
    return n_informative(col) >= 2


def strip_gaps(columns: DataFrame, mode: str = "any") -> DataFrame:
    """Without columns that are all gaps, or that have any gap."""
    gaps = F.length("col") - F.length(F.translate("col", GAP, ""))
    return columns.filter(gaps < F.length("col") if mode == "all" else gaps == 0)


def project(columns: DataFrame, row: int, by: Sequence[str] = ("aln",)) -> DataFrame:
    """Columns where a row has no gap, renumbered in its frame."""
    from tessera.operators.binned import bin_of, running

    kept = columns.filter(F.substring("col", row + 1, 1) != GAP)
    return running(kept, by, ["pos"], {"_n": F.lit(1)}, bin_of(kept, "pos")).withColumn("pos", F.col("_n").cast("int")).select(*columns.columns)


def coordinate_map(columns: DataFrame, row: int, by: Sequence[str] = ("aln",)) -> DataFrame:
    """by, pos and seq_pos: each alignment position with its place in a row (null in a gap)."""
    from tessera.operators.binned import bin_of, running

    there = F.substring("col", row + 1, 1) != GAP
    flagged = columns.select(*by, "pos", there.alias("_there"))
    counted = running(flagged, by, ["pos"], {"seq_pos": F.col("_there").cast("long")}, bin_of(flagged, "pos"))
    return counted.select(*by, "pos", F.when(F.col("_there"), F.col("seq_pos")).alias("seq_pos"))


def base_counts(columns: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """Counts of each symbol over all rows and columns, without gaps and missing ones."""
    chars = columns.groupBy("col").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.split("col", "")).alias("base"), "n")
    return chars.filter(F.length("base") == 1).filter(F.instr(F.lit(alphabet), F.col("base")) > 0).groupBy("base").agg(F.sum("n").alias("cnt"))


def normalised(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """freq: the share of cnt in its group's total, by a join with the few totals."""
    if not by:
        total = counts.agg(F.sum("cnt").alias("_t")).withColumn("_k", F.lit(1))  # one row
        return counts.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").withColumn("freq", F.col("cnt") / F.col("_t")).drop("_t", "_k")
    total = counts.groupBy(*by).agg(F.sum("cnt").alias("_t"))
    return counts.join(total, list(by)).withColumn("freq", F.col("cnt") / F.col("_t")).drop("_t")


def alignment_stats(columns: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """One row: symbol frequencies, length, columns of gaps only, columns with some gap."""
    per = columns.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    gaps = F.length("col") - F.length(F.translate("col", GAP, ""))
    count = {b: F.sum((F.length("col") - F.length(F.replace(F.col("col"), F.lit(b), F.lit("")))) * F.col("n")) for b in alphabet}
    total = None
    for c in count.values():
        total = c if total is None else total + c
    return per.agg(
        *[(c / total).alias(f"freq_{b}") for b, c in count.items()],
        F.sum("n").alias("length"),
        F.coalesce(F.sum(F.when(gaps == F.length("col"), F.col("n"))), F.lit(0)).alias("all_gaps"),
        F.coalesce(F.sum(F.when(gaps > 0, F.col("n"))), F.lit(0)).alias("some_gaps"),
    )


def pairwise_difference(counts: DataFrame, rows: int, skip_gaps: bool = True, skip_missing: bool = True) -> DataFrame:
    """a, b (0-based rows, a < b), compared, differing and p (0 where nothing is compared), from tuple counts."""
    pairs = [(i, j) for i in range(rows) for j in range(i + 1, rows)]
    skip = (GAP if skip_gaps else "") + (MISSING if skip_missing else "")
    one = counts.select("cnt", F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.substring("tuple", i + 1, 1).alias("x"), F.substring("tuple", j + 1, 1).alias("y")) for i, j in pairs])).alias("p"))
    ok = F.lit(True) if not skip else (F.instr(F.lit(skip), F.col("p.x")) == 0) & (F.instr(F.lit(skip), F.col("p.y")) == 0)
    out = one.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum(F.when(ok, F.col("cnt")).otherwise(0)).alias("compared"), F.sum(F.when(ok & (F.col("p.x") != F.col("p.y")), F.col("cnt")).otherwise(0)).alias("differing"))
    return out.withColumn("p", F.when(F.col("compared") > 0, F.col("differing") / F.col("compared")).otherwise(F.lit(0.0)))


def fourfold_degenerate(tuple_: Column, rows: int) -> Column:
    """For tuples of three columns: the first two bases are constant (missing ones skipped), no gap in the third, and their pair is four-fold degenerate."""

    def only(part: Column) -> Column:
        return F.array_distinct(F.filter(F.split(part, ""), lambda x: (x != "") & ~x.isin("*", "N")))

    first, second, third = (F.substring(tuple_, 1 + i * rows, rows) for i in range(3))
    a, b = only(first), only(second)
    pair = F.concat(F.element_at(a, 1), F.element_at(b, 1))
    return F.coalesce((F.size(a) == 1) & (F.size(b) == 1) & (F.instr(third, GAP) == 0) & pair.rlike("^([AT]C|[CG][^A-])$"), F.lit(False))


def missing_blocks(columns: DataFrame, reference: int, least: int, by: Sequence[str] = ("aln",)) -> DataFrame:
    """by, start, end of runs of at least `least` columns where every other row is missing; a trailing run counts whatever its length."""
    others = F.concat(F.substring(F.col("col"), 1, reference), F.expr(f"substring(col, {reference + 2})"))
    from tessera.operators.intervals import runs_where

    missing = n_informative(others) + F.length(others) - F.length(F.translate(others, GAP, "")) == 0
    runs = runs_where(columns, by, "pos", missing, F.lit(0)).select(*by, "start", "end")
    last = columns.groupBy(*by).agg(F.max("pos").alias("_last"))
    out = runs.join(last, list(by))
    return out.filter((F.col("end") - F.col("start") + 1 >= least) | (F.col("end") == F.col("_last"))).drop("_last")


def informative_runs(columns: DataFrame, by: Sequence[str] = ("aln",), least_symbols: int = 2) -> DataFrame:
    """Runs of informative columns as features."""
    from tessera.operators.intervals import runs_where

    return runs_where(columns, by, "pos", n_informative(F.col("col")) >= least_symbols, F.lit(0)).select(*by, "start", "end")


def expand(counts: DataFrame) -> DataFrame:
    """Each tuple as often as it was counted, with an artificial order."""
    one = counts.withColumn("_i", F.explode(F.expr("sequence(1, int(cnt))")))
    return one.select("tuple", F.monotonically_increasing_id().alias("pos"))


def permute_columns(columns: DataFrame, seed: int, by: Sequence[str] = ("aln",)) -> DataFrame:
    """Columns in a seeded random order inside each alignment: that of the MD5 of seed, alignment and position."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*by, "pos")]).cast("binary"))
    from tessera.operators.binned import running

    drawn = columns.withColumn("_key", key)
    place = running(drawn, by, ["_key", "pos"], {"_n": F.lit(1)}, F.substring("_key", 1, 3))
    return place.withColumn("pos", F.col("_n").cast("int")).select(*columns.columns)


def concatenate(first: DataFrame, second: DataFrame, by: Sequence[str] = ("aln",)) -> DataFrame:
    """The second alignment's columns after the first's."""
    ends = first.groupBy(*by).agg(F.max("pos").alias("_end"))
    moved = second.join(ends, list(by), "left").withColumn("pos", F.col("pos") + F.coalesce("_end", F.lit(0))).drop("_end")
    return first.unionByName(moved.select(*first.columns))


def difference(first: DataFrame, second: DataFrame, by: Sequence[str] = ("aln", "pos")) -> DataFrame:
    """Positions where two alignments differ or where only one has a column."""
    a, b = first.select(*by, F.col("col").alias("first")), second.select(*by, F.col("col").alias("second"))
    return a.join(b, list(by), "full").filter(~F.col("first").eqNullSafe(F.col("second")))


def strip_missing(columns: DataFrame, reference: int) -> DataFrame:
    """Without columns where every row but the reference is missing."""
    others = F.concat(F.substring(F.col("col"), 1, reference), F.expr(f"substring(col, {reference + 2})"))
    return columns.filter(F.length(F.translate(others, MISSING, "")) > 0)


def remove_zero_counts(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("cnt") > 0)


def shorten_context(counts: DataFrame, rows: int, k: int) -> DataFrame:
    """Tuples cut to their last k columns and counted again."""
    return recount(counts, F.expr(f"right(tuple, {rows * k})"))


def mask_long_gaps(columns: DataFrame, rows: int, most: int, reference: int | None = None, by: Sequence[str] = ("aln",)) -> DataFrame:
    """In each row (but the reference), runs of more than `most` gaps become missing.

    Only gaps that may be masked are looked at, and a run says its positions itself: other characters are neither sorted nor joined.
    """
    from tessera.operators.intervals import runs_where

    cells = columns.filter(F.col("col").contains(GAP)).select(*by, "pos", F.posexplode(F.split("col", "")).alias("row", "ch"))
    gaps = cells.filter((F.col("ch") == GAP) & (F.col("row") < rows) & (F.col("row") != F.lit(-1 if reference is None else reference)))
    runs = runs_where(gaps, [*by, "row"], "pos", F.lit(True), F.lit(0)).filter(F.col("n") > most)
    hit = runs.select(*by, "row", F.explode(F.sequence("start", "end")).alias("pos")).groupBy(*by, "pos").agg(F.collect_set("row").alias("_rows"))  # at most all rows
    met = columns.select(*by, "pos", "col").join(hit.hint("merge"), [*by, "pos"], "left")  # estimates don't see exploded rows: no broadcast
    masked = F.array_join(F.transform(F.split("col", ""), lambda ch, i: F.when(F.array_contains("_rows", i), "*").otherwise(ch)), "")
    return met.select(*by, "pos", F.when(F.col("_rows").isNull(), F.col("col")).otherwise(masked).alias("col"))


def missing_to_gaps(columns: DataFrame) -> DataFrame:
    return columns.withColumn("col", F.translate("col", MISSING, GAP * len(MISSING)))


def uppercase(columns: DataFrame) -> DataFrame:
    return columns.withColumn("col", F.upper("col"))


def split_by_category(columns: DataFrame, labels: DataFrame | str, by: Sequence[str] = ("aln",)) -> DataFrame:
    """Columns with the category of their position (0 where there is none), numbered anew inside each.

    labels: by, pos and cat, or the name of the columns' own column that holds the category.
    """
    from tessera.operators.binned import bin_of, running

    if isinstance(labels, str):
        met = columns.withColumnRenamed(labels, "cat")
    else:
        met = columns.join(labels.select(*by, "pos", "cat"), [*by, "pos"], "left")
    met = met.withColumn("cat", F.coalesce("cat", F.lit(0)))
    return running(met, [*by, "cat"], ["pos"], {"_n": F.lit(1)}, bin_of(met, "pos")).withColumn("pos", F.col("_n").cast("int")).select(*met.columns)


def extract_features(columns: DataFrame, feats: DataFrame, by: Sequence[str] = ("aln",)) -> DataFrame:
    """The columns inside features, each with the feature's number and its place in it."""
    from tessera.operators.intervals import overlap_pairs

    points = columns.withColumn("start", F.col("pos")).withColumn("end", F.col("pos"))
    met = overlap_pairs(points, feats.select(*by, "start", "end", "id"), by)
    return met.select(*by, F.col("r_id").alias("id"), (F.col("pos") - F.col("r_start") + 1).alias("pos"), "col")


def map_features(feats: DataFrame, mapping: DataFrame, by: Sequence[str] = ("aln",)) -> DataFrame:
    """Features from a row's frame to the alignment's, with a table of (by, pos, seq_pos); ends outside the row are cut, wholly unmapped ones go."""
    known = mapping.filter(F.col("seq_pos").isNotNull())
    ends = known.groupBy(*by).agg(F.min("seq_pos").alias("_lo"), F.max("seq_pos").alias("_hi"))
    cut = feats.join(ends, list(by)).filter((F.col("end") >= F.col("_lo")) & (F.col("start") <= F.col("_hi")))
    cut = cut.withColumn("start", F.greatest("start", "_lo")).withColumn("end", F.least("end", "_hi")).drop("_lo", "_hi")
    a = known.select(*by, F.col("seq_pos").alias("start"), F.col("pos").alias("_a"))
    b = known.select(*by, F.col("seq_pos").alias("end"), F.col("pos").alias("_b"))
    return cut.join(a, [*by, "start"]).join(b, [*by, "end"]).withColumn("start", F.col("_a")).withColumn("end", F.col("_b")).select(*feats.columns)


def sequence_lengths(columns: DataFrame, rows: int, by: Sequence[str] = ("aln",)) -> DataFrame:
    """Length of each row without gaps."""
    return columns.groupBy(*by).agg(*[F.sum((F.substring("col", i + 1, 1) != GAP).cast("long")).alias(f"row{i}") for i in range(rows)])


def codon_frequencies(counts: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """codon and freq: products of the base frequencies at the three codon positions, from counts (at, base, cnt), stops left out and scaled to 1."""
    from tessera.functions.sequences import CODONS

    freq = normalised(counts.filter(F.col("base").isin(list(alphabet))), ["at"]).select("at", "base", "freq")
    out = None
    for i in range(3):
        one = freq.filter(F.col("at") == i).select(F.lit(1).alias("_k"), F.col("base").alias(f"b{i}"), F.col("freq").alias(f"f{i}"))
        out = one if out is None else out.join(one, "_k")
    codons = out.select(F.concat("b0", "b1", "b2").alias("codon"), (F.col("f0") * F.col("f1") * F.col("f2")).alias("cnt"))
    return normalised(codons.filter(~F.col("codon").isin([c for c, a in CODONS.items() if a == "*"]))).select("codon", "freq")
