"""Readers and writers of alignments: FASTA, PHYLIP, MPM, AXT, MAF, LAV and tables of counted columns.

The readers of large formats (FASTA, MAF) work on lines or blocks in the cluster; formats whose parts depend on a
header far above (PHYLIP, MPM, counted columns) are small by nature and are parsed from one file's text in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.sequences import complement
from tessera.runtime import numbered

LONG = "aln string, seq string, pos long, ch string"


def sniff(first: str) -> str:
    text = first.strip()
    if text.startswith(">"):
        return "fasta"
    if text.startswith("##maf"):
        return "maf"
    if text.startswith("#:lav"):
        return "lav"
    if text.startswith("NSEQS"):
        return "ss"
    parts = text.split()
    if len(parts) == 2 and all(p.isdigit() for p in parts):
        return "phylip"
    if len(parts) >= 8 and parts[0].isdigit():
        return "axt"
    return "unknown"


def format_for_suffix(path: str) -> str:
    return {"fa": "fasta", "fasta": "fasta", "ss": "ss", "maf": "maf", "ph": "phylip", "phy": "phylip", "mpm": "mpm", "lav": "lav", "axt": "axt"}.get(path.rsplit(".", 1)[-1].lower(), "unknown")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq, text and ord of every record; line breaks and spaces go, ord rises along a file. Lines before the first record have no part.

    Files are split where a line starts with the sign of a record, so records are read in parallel and no file's lines are sorted.
    """
    t = spark.read.option("lineSep", "\n>").text(path).select(F.col("value").alias("v"), F.monotonically_increasing_id().alias("ord"), F.input_file_name().alias("path"))
    firsts = t.groupBy("path").agg(F.min("ord").alias("_first"))  # one row for each file
    met = t.join(firsts, "path").withColumn("_first", F.col("ord") == F.col("_first")).filter(~F.col("_first") | F.col("v").startswith(">"))
    whole = met.withColumn("v", F.when(F.col("_first"), F.expr("substring(v, 2)")).otherwise(F.col("v"))).withColumn("_head", F.substring_index("v", "\n", 1))
    texts = whole.select(F.regexp_extract("_head", r"^\s*(\S+)", 1).alias("seq"), F.regexp_replace(F.expr("substring(v, length(_head) + 2)"), r"\s", "").alias("text"), "ord")
    return texts.filter("text <> ''")


def to_long(records: DataFrame, aln: str = "a") -> DataFrame:
    """(aln, seq, pos, ch) from (seq, text): characters are split once per record."""
    return records.select(F.lit(aln).alias("aln"), "seq", F.posexplode(F.split("text", "")).alias("pos", "ch")).filter("ch <> ''").withColumn("pos", (F.col("pos") + 1).cast("long"))


def equal_lengths(records: DataFrame) -> bool:
    return records.select(F.length("text").alias("n")).distinct().limit(2).count() <= 1


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """seq and text: a header with two numbers, then names and rows, also interleaved."""
    return _whole(spark, path, _phylip)


def _phylip(text: str) -> list[tuple[str, str]]:
    rows = [x for x in text.split("\n") if x.strip()]
    n = int(rows[0].split()[0])
    names, parts = [], []
    for i, row in enumerate(rows[1:]):
        if i < n:
            name, *rest = row.split()
            names.append(name)
            parts.append("".join(rest))
        else:
            parts[i % n] += "".join(row.split())
    return list(zip(names, parts))


def read_mpm(spark: SparkSession, path: str) -> DataFrame:
    """seq and text: a header with two numbers, all names, then all rows."""
    return _whole(spark, path, _mpm)


def _mpm(text: str) -> list[tuple[str, str]]:
    rows = [x.strip() for x in text.split("\n") if x.strip()]
    n = int(rows[0].split()[0])
    return list(zip(rows[1 : n + 1], ["".join(r.split()) for r in rows[n + 1 : 2 * n + 1]]))


def _whole(spark: SparkSession, path: str, parse) -> DataFrame:
    files = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["value"]:
                yield pd.DataFrame(parse(text), columns=["seq", "text"])

    return files.mapInPandas(run, "seq string, text string")


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(tuple, cnt) of a file of counted columns and its header."""
    t = spark.read.text(path)
    head = {r["value"].split("=")[0].strip(): r["value"].split("=", 1)[1].strip() for r in t.filter(F.col("value").rlike(r"^[A-Z_]+\s*=")).collect()}
    p = t.filter(F.col("value").rlike(r"^[0-9]+\s")).select(F.split("value", r"\s+").alias("p"))
    k, n = int(head.get("TUPLE_SIZE", 1)), int(head["NSEQS"])
    cells = F.slice("p", 2, n) if k > 1 else None
    tuple_ = F.get("p", F.lit(1)) if cells is None else F.concat(*[F.substring(F.get(cells, F.lit(s)), i + 1, 1) for i in range(k) for s in range(n)])
    count = F.get("p", F.lit(2 if cells is None else n + 1)).cast("double")
    return p.select(F.get("p", F.lit(0)).cast("long").alias("tuple_id"), tuple_.alias("tuple"), count.alias("cnt")), head


def counts_lines(counts: DataFrame, names: Sequence[str], length: int, alphabet: str = "ACGT") -> DataFrame:
    """The file's header as the first row and a line for each tuple, most frequent first."""
    head = counts.agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(f"NSEQS = {len(names)}\nLENGTH = {length}\nTUPLE_SIZE = 1\nNTUPLES = "), "n", F.lit(f"\nNAMES = {','.join(names)}\nALPHABET = {alphabet}\nNCATS = -1\n")).alias("value"), F.lit(-1).cast("long").alias("i"))
    body = numbered(counts, [F.col("cnt").desc(), F.col("tuple")], "i").select(F.concat_ws("\t", F.col("i").cast("string"), "tuple", F.col("cnt").cast("long").cast("string")).alias("value"), "i")
    return head.unionByName(body).orderBy("i").select("value")


def fasta_lines(records: DataFrame, width: int = 70) -> DataFrame:
    return records.select(F.concat(F.lit("> "), "seq", F.lit("\n"), F.regexp_replace("text", rf"(.{{{width}}})(?=.)", "$1\n")).alias("value"))


def phylip_lines(records: DataFrame) -> DataFrame:
    head = records.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("l")).select(F.concat_ws(" ", F.col("n").cast("string"), F.col("l").cast("string")).alias("value"))
    return head.unionByName(records.select(F.concat(F.rpad("seq", 11, " "), "text").alias("value")))


# -- blocks ------------------------------------------------------------------------------------------------------------

MAF_ROW = "src string, start long, size long, strand string, src_size long, text string, quality string"


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """block and rows of every alignment block: files are split at blank lines, so blocks are read in parallel."""
    t = spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("b"), F.monotonically_increasing_id().alias("block")).filter(F.col("b").rlike(r"(?m)^a\b|^s\b"))
    row = F.split("b", "\n")
    rows = t.select("block", F.posexplode(row).alias("k", "line")).filter(F.col("line").rlike("^s\\s"))
    p = rows.select("block", "k", F.split(F.trim("line"), r"\s+").alias("p"))
    return p.select("block", F.col("k").cast("int").alias("k"), F.get("p", F.lit(1)).alias("src"), F.regexp_extract(F.get("p", F.lit(1)), r"^[^.]+", 0).alias("seq"), F.get("p", F.lit(2)).cast("long").alias("start"), F.get("p", F.lit(3)).cast("long").alias("size"), F.get("p", F.lit(4)).alias("strand"), F.get("p", F.lit(5)).cast("long").alias("src_size"), F.get("p", F.lit(6)).alias("text"))


def maf_columns(maf: DataFrame, reference: str, names: Sequence[str], drop_reference_gaps: bool = True) -> DataFrame:
    """(pos in the reference, col) of all blocks, rows in the order of names, absent ones missing.

    A block's texts come to one row and are zipped, so blocks meet by one shuffle and characters by none.
    """
    seqs = list(dict.fromkeys([reference, *names]))
    wide = maf.filter(F.col("seq").isin(seqs)).groupBy("block").agg(F.map_from_entries(F.collect_set(F.struct("seq", "text"))).alias("m"), F.min(F.when(F.col("seq") == reference, F.col("start"))).alias("_s"))
    letters = F.arrays_zip(*[F.coalesce(F.split(F.col("m")[n], ""), F.array()).alias(f"_{i}") for i, n in enumerate(seqs)])
    cells = F.filter(F.transform(letters, lambda x, at: F.struct(at.alias("at"), *[x[f"_{i}"].alias(f"_{i}") for i in range(len(seqs))])), lambda x: x["_0"] != "")
    col = F.concat(*[F.upper(F.coalesce(F.nullif(F.col(f"x._{seqs.index(n)}"), F.lit("")), F.lit("*"))) for n in names]).alias("col")
    if drop_reference_gaps:
        bases = wide.select("block", "_s", F.posexplode(F.filter(cells, lambda x: x["_0"] != "-")).alias("_i", "x"))
        return bases.select("block", "x.at", (F.col("_s") + F.col("_i") + 1).alias("pos"), col)
    w = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = wide.select("block", "_s", F.explode(cells).alias("x")).select("block", "_s", "x.at", "x")
    return each.select("block", "at", (F.col("_s") + F.sum((F.col("x._0") != "-").cast("long")).over(w)).alias("pos"), col)


def maf_line(src: Column, start: Column, size: Column, strand: Column, src_size: Column, text: Column) -> Column:
    return F.concat(F.lit("s "), F.rpad(src, 20, " "), F.lpad(start.cast("string"), 10, " "), F.lit(" "), F.lpad(size.cast("string"), 8, " "), F.lit(" "), strand, F.lit(" "), F.lpad(src_size.cast("string"), 10, " "), F.lit(" "), text)


def maf_blocks(blocks: DataFrame) -> DataFrame:
    """A row of text for each (block, lines), blocks in order; blocks that come dealt by ranges of block are not moved again."""
    return blocks.select("block", F.concat(F.lit("a score=0\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("value")).orderBy("block").select("value")


def maf_lines(maf: DataFrame) -> DataFrame:
    """The same from rows, which are gathered to blocks."""
    line = maf_line(*[F.col(c) for c in ("src", "start", "size", "strand", "src_size", "text")])
    lines = F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"])
    return maf_blocks(maf.groupBy("block").agg(lines.alias("lines")))


def trim_maf(maf: DataFrame, reference: str, start: int, end: int) -> DataFrame:
    """Blocks cut to reference positions [start, end] (1-based)."""
    ref = maf.filter(F.col("seq") == reference).select("block", F.col("start").alias("_s"), F.posexplode(F.split("text", "")).alias("at", "_r")).filter("_r <> ''")
    w = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.col("_s") + F.sum((F.col("_r") != "-").cast("long")).over(w)
    kept = ref.withColumn("pos", pos).filter((F.col("pos") >= start) & (F.col("pos") <= end) & (F.col("_r") != "-")).groupBy("block").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    cut = maf.join(kept, "block")
    bases = lambda s: F.length(F.translate(s, "-", ""))
    before = F.substr("text", F.lit(1), F.col("lo").cast("int"))
    text = F.substr("text", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int"))
    return cut.select("block", "k", "src", "seq", (F.col("start") + bases(before)).alias("start"), bases(text).cast("long").alias("size"), "strand", "src_size", text.alias("text"))


def read_axt(spark: SparkSession, path: str) -> DataFrame:
    """block, target and query (name, start, end), strand and both texts of every pairwise block."""
    t = spark.read.option("lineSep", "\n\n").text(path).select(F.split(F.trim("value"), "\n").alias("l")).select(F.filter("l", lambda x: ~x.startswith("#")).alias("l")).filter(F.size("l") >= 3)
    h = F.split(F.get("l", F.lit(0)), r"\s+")
    g = lambda i: F.get(h, F.lit(i))
    return t.select(g(0).cast("long").alias("block"), g(1).alias("target"), g(2).cast("long").alias("t_start"), g(3).cast("long").alias("t_end"), g(4).alias("query"), g(5).cast("long").alias("q_start"), g(6).cast("long").alias("q_end"), g(7).alias("strand"), F.get("l", F.lit(1)).alias("t_text"), F.get("l", F.lit(2)).alias("q_text"))


def read_lav(spark: SparkSession, path: str) -> DataFrame:
    """block and its gapless segments: qs, ts, qe, te and percent identity."""
    t = spark.read.option("lineSep", "a {").text(path).select(F.col("value").alias("b"), F.monotonically_increasing_id().alias("block"))
    seg = F.regexp_extract_all("b", F.lit(r"(?m)^\s*l\s+([0-9]+\s+[0-9]+\s+[0-9]+\s+[0-9]+\s+[0-9.]+)"), F.lit(1))
    p = t.select("block", F.explode(seg).alias("s")).select("block", F.split("s", r"\s+").alias("p"))
    return p.select("block", *[F.get("p", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("qs", "ts", "qe", "te"))], F.get("p", F.lit(4)).cast("double").alias("identity"))


def reverse_complement_rows(records: DataFrame) -> DataFrame:
    return records.withColumn("text", F.reverse(complement(F.col("text"))))


def sub_species(maf: DataFrame, names: Sequence[str], exclude: bool = False) -> DataFrame:
    hit = F.col("seq").isin(list(names))
    return maf.filter(~hit if exclude else hit)


def reorder_species(maf: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of each block in the order of names; others go."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("seq"))
    return maf.filter(place > 0).withColumn("k", place.cast("int"))


def remove_gap_columns(maf: DataFrame) -> DataFrame:
    """Blocks without the columns that are gaps in all rows that are left."""
    chars = maf.select("block", "k", F.posexplode(F.split("text", "")).alias("at", "ch")).filter("ch <> ''")
    kept = chars.groupBy("block", "at").agg(F.max((F.col("ch") != "-").cast("int")).alias("_b")).filter("_b = 1").drop("_b")
    back = chars.join(kept, ["block", "at"]).groupBy("block", "k").agg(F.sort_array(F.collect_list(F.struct("at", "ch"))).alias("_x"))
    texts = back.select("block", "k", F.array_join(F.transform("_x", lambda x: x["ch"]), "").alias("_t"))
    return maf.join(texts, ["block", "k"]).withColumn("text", F.col("_t")).select(*maf.columns)


def mask_regions(maf: DataFrame, feats: DataFrame, names: Sequence[str]) -> DataFrame:
    """Bases of the named species inside features (seqname: the row's src, 1-based) become N."""
    from tessera.operators.intervals import overlap_pairs

    chars = maf.filter(F.col("seq").isin(list(names))).select("block", "k", "src", "start", F.posexplode(F.split("text", "")).alias("at", "ch")).filter("ch <> ''")
    w = Window.partitionBy("block", "k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = chars.withColumn("_p", F.col("start") + F.sum((F.col("ch") != "-").cast("long")).over(w)).filter("ch <> '-'")
    points = placed.select("block", "k", "at", F.col("src").alias("seqname"), F.col("_p").alias("start"), F.col("_p").alias("end"))
    hit = overlap_pairs(points, feats.select("seqname", "start", "end")).select("block", "k", "at").distinct().withColumn("_hit", F.lit(True))
    back = chars.join(hit, ["block", "k", "at"], "left").withColumn("ch", F.when(F.col("_hit"), "N").otherwise(F.col("ch")))
    texts = back.groupBy("block", "k").agg(F.sort_array(F.collect_list(F.struct("at", "ch"))).alias("_x")).select("block", "k", F.array_join(F.transform("_x", lambda x: x["ch"]), "").alias("_t"))
    return maf.join(texts, ["block", "k"], "left").withColumn("text", F.coalesce("_t", "text")).select(*maf.columns)
