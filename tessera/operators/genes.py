"""Checks and shaping of coding regions: reading frames, stops, splice sites, gaps and cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.sequences import CODONS
from tessera.operators import intervals

#: Signals of the standard genetic code and of splicing.
STOPS = ("TAA", "TAG", "TGA")
SPLICE_PAIRS = (("GT", "AG"), ("GC", "AG"), ("AT", "AC"))
_TURN = str.maketrans("ACGTacgt", "TGCAtgca")


def gap_runs(text: str) -> list[tuple[int, int]]:
    """(start, length) of runs of gaps."""
    out, at = [], 0
    while (at := text.find("-", at)) >= 0:
        end = at
        while end < len(text) and text[end] == "-":
            end += 1
        out.append((at, end - at))
        at = end
    return out


def gap_class(rows: Sequence[str]) -> str:
    """'none', 'clean' (all gap runs are multiples of 3), 'nonoverlapping' (frames are restored before the next block) or 'frameshift'."""
    runs = [gap_runs(r) for r in rows]
    if not any(runs):
        return "none"
    if all(n % 3 == 0 for rs in runs for _, n in rs):
        return "clean"
    return "nonoverlapping" if frame_kept(rows) else "frameshift"


def frame_kept(rows: Sequence[str], block: int = 15) -> bool:
    """Whether, between gapless blocks of at least `block` columns, every row has as many gaps as the first one modulo 3."""
    n = len(rows[0])
    totals, quiet = [0] * len(rows), 0
    for i in range(n + 1):
        gaps = [i < n and r[i] == "-" for r in rows]
        if i < n and not any(gaps):
            quiet += 1
            continue
        if quiet >= block or i == n:
            if any((t - totals[0]) % 3 for t in totals):
                return False
            totals = [0] * len(rows)
        quiet = 0
        for k, g in enumerate(gaps):
            totals[k] += g
    return not any((t - totals[0]) % 3 for t in totals)


def stop_inside(text: str) -> bool:
    """Whether a codon before the last is a stop, gaps left out."""
    bases = text.replace("-", "").upper()
    return any(bases[i : i + 3] in STOPS for i in range(0, len(bases) - 5, 3))


def n_share(text: str) -> tuple[int, int]:
    """Bases that are no gaps, and how many of them are N."""
    bases = text.replace("-", "").upper()
    return len(bases), bases.count("N") + bases.count("*")


def check_gene(rows: Sequence[str], strand: str = "+", most_n: float = 0.05, splice: Sequence[tuple[str, str]] = ()) -> str:
    """The first reason to reject a gene given its aligned coding rows (and, for each row, donor and acceptor pairs), or 'ok'."""
    if strand == "-":
        rows = [r.translate(_TURN)[::-1] for r in rows]
    for r in rows:
        bases = r.replace("-", "").upper()
        if len(bases) < 6 or bases[:3] != "ATG" and "N" not in bases[:3]:
            return "bad_start"
        if bases[-3:] not in STOPS and "N" not in bases[-3:]:
            return "bad_stop"
    for donor, acceptor in splice:
        if (donor.upper(), acceptor.upper()) not in SPLICE_PAIRS and "N" not in donor + acceptor:
            return "bad_intron"
    if gap_class(rows) == "frameshift":
        return "frameshift"
    if any(stop_inside(r) for r in rows):
        return "nonsense"
    for r in rows:
        n, unknown = n_share(r)
        if unknown > most_n * n:
            return "too_many_n"
    return "ok"


def clean_genes(genes: DataFrame, by: Sequence[str], rows: str = "rows", most_n: float = 0.05) -> DataFrame:
    """by and reason for each gene, given an array of aligned coding rows and its strand."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in genes.schema if f.name in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[list(by)].assign(reason=[check_gene(list(r), s, most_n) for r, s in zip(pdf[rows], pdf["strand"])])

    return genes.mapInPandas(run, f"{keys}, reason string")


def codon_clean(rows: Sequence[str], reference: int = 0, strand: str = "+") -> list[str]:
    """Rows in the reference's frame (its gap columns go), whole codons, masked with N from their first stop on."""
    keep = [i for i, c in enumerate(rows[reference]) if c != "-"]
    out = ["".join(r[i] for i in keep) for r in rows]
    if len(keep) % 3:
        raise ValueError("the reference's length is not a multiple of 3")
    if strand == "-":
        out = [r.translate(_TURN)[::-1] for r in out]
    masked = []
    for r in out:
        stop = next((i for i in range(0, len(r), 3) if r[i : i + 3].upper() in STOPS), None)
        masked.append(r if stop is None else r[:stop] + "N" * (len(r) - stop))
    return masked


def indel_clean(rows: Sequence[str], border: int, least_bases: int, least_rows: int) -> list[str]:
    """Masked with N: bases within `border` of a gap, runs shorter than `least_bases`, and columns with too few rows left."""
    out = []
    for r in rows:
        near = [False] * len(r)
        for s, n in gap_runs(r):
            for i in range(max(0, s - border), min(len(r), s + n + border)):
                near[i] = True
        chars = ["N" if x and c != "-" else c for c, x in zip(r, near)]
        at = 0
        while at < len(chars):
            end = at
            while end < len(chars) and chars[end] not in "-N*":
                end += 1
            if 0 < end - at < least_bases:
                chars[at:end] = "N" * (end - at)
            at = max(end, at + 1)
        out.append("".join(chars))
    few = [sum(r[i] not in "-N*" for r in out) < least_rows for i in range(len(rows[0]))]
    return ["".join("N" if f and c != "-" else c for c, f in zip(r, few)) for r in out]


def translate_rows(rows: Sequence[str]) -> list[str]:
    """Amino acids of each row in the common frame; '-' for gap codons, 'X' for what is unclear."""
    return ["".join("-" if r[i : i + 3] == "---" else CODONS.get(r[i : i + 3].upper(), "X") for i in range(0, len(r) - 2, 3)) for r in rows]


def refeature(feats: DataFrame, keep: Iterable[str] | None = None, group: str | None = None, add: Iterable[str] = (), unique: bool = False, fix: bool = False) -> DataFrame:
    """The feature pipeline in its fixed order: types, grouping by a tag, added introns, UTRs and signals, sorting, overlaps, codons."""
    out = feats if keep is None else intervals.filter_by_type(feats, keep)
    by = ("seqname", "grp")
    if group is not None:
        out = intervals.group_by_tag(out, group)
        exons, cds = out.filter("feature = 'exon'"), out.filter("feature = 'CDS'")
        made = {"introns": lambda: intervals.introns(exons, by), "utrs": lambda: intervals.utrs(exons, cds, by), "signals": lambda: intervals.signals(cds, by)}
        for name in add:
            out = out.unionByName(made[name]().select(*out.columns))
    if unique:
        out = intervals.remove_overlaps(out)
    if fix:
        out = intervals.fix_start_stop(out, by)
    return intervals.sort_features(out)


def string_exons(exons: DataFrame, most_gap: int, by: Sequence[str] = ("seqname", "strand")) -> DataFrame:
    """Exons of a strand numbered into fragments: a new one starts after a gap of more than `most_gap`."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("start", "end")
    new = F.lag("end").over(w).isNull() | (F.col("start") - F.lag("end").over(w) > most_gap)
    return exons.withColumn("_n", new.cast("int")).withColumn("fragment", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def classify_exons(real: DataFrame, called: DataFrame, by: Sequence[str] = ("seqname",)) -> DataFrame:
    """Each real or called exon as correct, partial (one end agrees), overlapping, missed or wrong."""
    pairs = intervals.overlap_pairs(real.select(*by, "start", "end"), called.select(*by, "start", "end"), by)
    both = F.when((F.col("start") == F.col("r_start")) & (F.col("end") == F.col("r_end")), 3).when((F.col("start") == F.col("r_start")) | (F.col("end") == F.col("r_end")), 2).otherwise(1)

    def side(frame: DataFrame, start: str, end: str, none: str, name: str) -> DataFrame:
        best = pairs.groupBy(*[F.col(f"{'r_' if start.startswith('r_') else ''}{k}").alias(k) for k in by], F.col(start).alias("start"), F.col(end).alias("end")).agg(F.max(both).alias("_b"))
        label: Column = F.when(F.col("_b") == 3, "correct").when(F.col("_b") == 2, "partial").when(F.col("_b") == 1, "overlapping").otherwise(none)
        return frame.select(*by, "start", "end").join(best, [*by, "start", "end"], "left").select(F.lit(name).alias("side"), *by, "start", "end", label.alias("class"))

    return side(real, "start", "end", "missed", "real").unionByName(side(called, "r_start", "r_end", "wrong", "called"))
