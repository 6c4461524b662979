"""Readers of interval formats into feature rows: seqname, source, feature, start, end, score, strand, frame, attribute.

Positions become 1-based with both ends included, whatever the format has. Files are read as text lines by Spark, so
paths may be of any store that it knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attribute")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line and its number in the file (offsets grow with the place in a file)."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("n"))


def _null(c: Column, sign: str = ".") -> Column:
    return F.when(F.trim(c) == sign, None).otherwise(F.trim(c))


def sniff(first: str) -> str:
    """Format of a first line: wig, genepred, bed or gff."""
    parts = first.rstrip("\n").split("\t")
    if first.startswith(("fixedStep", "variableStep", "track type=wiggle")):
        return "wig"
    if first.startswith("##") or (len(parts) >= 8 and parts[3].isdigit() and parts[4].isdigit() and parts[6] in "+-."):
        return "gff"
    at = 1 if len(parts) > 10 and parts[0].isdigit() else 0
    if first.startswith("#name") or (len(parts) >= 10 and parts[at + 2] in ("+", "-") and "," in parts[at + 8]):
        return "genepred"
    if len(parts) >= 3 and parts[1].isdigit() and parts[2].isdigit():
        return "bed"
    return "gff"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Any of the formats, told from the first line that is not empty."""
    first = next((r["value"] for r in spark.read.text(path).limit(20).collect() if r["value"].strip()), "")
    return {"wig": read_wig, "gff": read_gff, "genepred": read_genepred, "bed": read_bed}[sniff(first)](spark, path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """At least five columns; score, strand, frame and attribute may be missing. Frames turn from GFF's to the internal ones."""
    t = lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    p = t.select(F.split("line", "\t").alias("p")).filter(F.size("p") >= 5)

    def at(i: int) -> Column:
        return F.get("p", F.lit(i))

    frame = _null(at(7)).try_cast("int")
    return p.select(
        F.trim(at(0)).alias("seqname"), F.trim(at(1)).alias("source"), F.trim(at(2)).alias("feature"), at(3).cast("long").alias("start"), at(4).cast("long").alias("end"),
        _null(at(5)).try_cast("double").alias("score"), F.coalesce(F.trim(at(6)), F.lit(".")).alias("strand"), F.pmod(3 - frame, F.lit(3)).alias("frame"), F.coalesce(at(8), F.lit(".")).alias("attribute"),
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED3 to BED12: the start moves by one; repeated names get .2, .3 and so on; blocks become rows."""
    t = lines(spark, path).filter(~F.col("line").rlike("^(#|track|browser)") & (F.trim("line") != ""))
    p = t.select("n", F.split(F.trim("line"), r"\s+").alias("p")).filter(F.size("p") >= 3)

    def at(i: int) -> Column:
        return F.get("p", F.lit(i))

    rows = p.select("n", at(0).alias("seqname"), at(1).cast("long").alias("s"), at(2).cast("long").alias("e"), F.coalesce(at(3), F.lit("")).alias("name"), at(4).try_cast("double").alias("score"), F.coalesce(at(5), F.lit(".")).alias("strand"), at(9).try_cast("int").alias("blocks"), at(10).alias("sizes"), at(11).alias("starts"))
    again = F.row_number().over(Window.partitionBy("name").orderBy("n"))
    rows = rows.withColumn("k", F.when(F.col("name") == "", 1).otherwise(again)).withColumn("name", F.when(F.col("k") > 1, F.concat("name", F.lit("."), "k")).otherwise(F.col("name")))
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("o"), (F.col("e") - F.col("s")).alias("l")))
    blocks = F.transform(F.arrays_zip(numbers(F.col("starts")).alias("o"), numbers(F.col("sizes")).alias("l")), lambda x: F.struct(x["o"].alias("o"), x["l"].alias("l")))
    each = rows.withColumn("b", F.explode(F.when(F.col("blocks") > 1, blocks).otherwise(whole)))
    return each.select("seqname", F.lit("bed").alias("source"), F.lit("feature").alias("feature"), (F.col("s") + F.col("b.o") + 1).alias("start"), (F.col("s") + F.col("b.o") + F.col("b.l")).alias("end"), "score", "strand", F.lit(None).cast("int").alias("frame"), F.when(F.col("name") != "", F.concat(F.lit('id "'), "name", F.lit('"'))).otherwise(".").alias("attribute"))


def read_genepred(spark: SparkSession, path: str) -> DataFrame:
    """Exon and CDS rows of each gene, with the CDS frames; a leading bin column is recognised."""
    t = lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    p = t.select(F.split("line", "\t").alias("p"))
    p = p.select(F.when(F.get("p", F.lit(0)).rlike("^[0-9]+$") & F.get("p", F.lit(3)).isin("+", "-"), F.slice("p", 2, 100)).otherwise(F.col("p")).alias("p")).filter(F.size("p") >= 10)

    def at(i: int) -> Column:
        return F.get("p", F.lit(i))

    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    g = p.select(at(0).alias("name"), at(1).alias("seqname"), at(2).alias("strand"), (at(5).cast("long") + 1).alias("cs"), at(6).cast("long").alias("ce"), F.arrays_zip(numbers(at(8)).alias("s"), numbers(at(9)).alias("e")).alias("exons"))
    e = g.withColumn("x", F.explode("exons")).select("name", "seqname", "strand", "cs", "ce", (F.col("x.s") + 1).alias("start"), F.col("x.e").alias("end"))
    exon = e.select("seqname", "name", "strand", F.lit("exon").alias("feature"), "start", "end", F.lit(None).cast("int").alias("frame"))
    c = e.filter("cs <= ce and start <= ce and end >= cs").withColumn("start", F.greatest("start", "cs")).withColumn("end", F.least("end", "ce"))
    w = Window.partitionBy("seqname", "name").orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))).rowsBetween(Window.unboundedPreceding, -1)
    cds = c.select("seqname", "name", "strand", F.lit("CDS").alias("feature"), "start", "end", (F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w), F.lit(0)) % 3).cast("int").alias("frame"))
    both = exon.unionByName(cds)
    return both.select("seqname", F.lit("genepred").alias("source"), "feature", "start", "end", F.lit(None).cast("double").alias("score"), "strand", "frame", F.concat(F.lit('transcript_id "'), "name", F.lit('"')).alias("attribute"))


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """Fixed and variable steps, also mixed: each value is a feature on the plus strand. Headers carry on over the following lines."""
    t = lines(spark, path).filter(~F.col("line").rlike("^(#|track|browser)") & (F.trim("line") != ""))
    head = F.when(F.col("line").rlike("^(fixedStep|variableStep)"), F.struct("n", "line"))
    # headers are rare: each line takes the last one before it
    w = Window.partitionBy(F.lit(0)).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    h = t.withColumn("h", F.last(head, ignorenulls=True).over(w)).filter(~F.col("line").rlike("^(fixedStep|variableStep)"))
    text = F.col("h.line")
    value = lambda key, default: F.coalesce(F.nullif(F.regexp_extract(text, rf"\b{key}=(\S+)", 1), F.lit("")), F.lit(default))
    rows = h.select("n", "line", text.startswith("fixedStep").alias("fixed"), value("chrom", "").alias("seqname"), value("start", "1").cast("long").alias("s"), value("step", "1").cast("long").alias("step"), value("span", "1").cast("long").alias("span"), F.col("h.n").alias("block"))
    k = F.row_number().over(Window.partitionBy("block").orderBy("n")) - 1
    parts = F.split(F.trim("line"), r"\s+")
    start = F.when(F.col("fixed"), F.col("s") + k * F.col("step")).otherwise(F.get(parts, F.lit(0)).cast("long"))
    score = F.when(F.col("fixed"), F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1))).cast("double")
    return rows.select("seqname", F.lit("wig").alias("source"), F.lit("score").alias("feature"), start.alias("start"), (start + F.col("span") - 1).alias("end"), score.alias("score"), F.lit("+").alias("strand"), F.lit(None).cast("int").alias("frame"), F.lit(".").alias("attribute"))


def parse_position(text: Column) -> Column:
    """`chr:start-end` with an optional strand as a struct; null where it is not one."""
    p = r"^([^:]+):([0-9]+)-([0-9]+)([+-]?)$"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("seqname"), F.regexp_extract(text, p, 2).cast("long").alias("start"), F.regexp_extract(text, p, 3).cast("long").alias("end"), F.coalesce(F.nullif(F.regexp_extract(text, p, 4), F.lit("")), F.lit(".")).alias("strand")))


# -- writers -----------------------------------------------------------------------------------------------------------


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("."))


def gff_lines(feats: DataFrame) -> DataFrame:
    frame = F.coalesce(F.pmod(3 - F.col("frame"), F.lit(3)).cast("string"), F.lit("."))
    return feats.select(F.concat_ws("\t", "seqname", "source", "feature", F.col("start").cast("string"), F.col("end").cast("string"), _text("score"), "strand", frame, _text("attribute")).alias("value"))


def bed_lines(feats: DataFrame, group: str | None = None) -> DataFrame:
    """BED6 lines, or BED12 lines of the groups."""
    name = F.coalesce(F.nullif(F.regexp_extract("attribute", '"([^"]+)"', 1), F.lit("")), F.lit("."))
    if group is None:
        return feats.select(F.concat_ws("\t", "seqname", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), name, F.coalesce(F.col("score"), F.lit(0)).cast("int").cast("string"), "strand").alias("value"))
    g = feats.groupBy("seqname", group).agg(F.min("start").alias("s"), F.max("end").alias("e"), F.first("strand").alias("strand"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("b"))
    sizes = F.array_join(F.transform("b", lambda x: (x["end"] - x["start"] + 1).cast("string")), ",")
    starts = F.array_join(F.transform("b", lambda x: (x["start"] - F.col("s")).cast("string")), ",")
    s0, e = (F.col("s") - 1).cast("string"), F.col("e").cast("string")
    return g.select(F.concat_ws("\t", "seqname", s0, e, group, F.lit("0"), "strand", s0, e, F.lit("0"), F.size("b").cast("string"), sizes, starts).alias("value"))


def genepred_lines(feats: DataFrame, group: str = "grp") -> DataFrame:
    is_cds = F.col("feature") == "CDS"
    exons = F.sort_array(F.filter(F.collect_list(F.when(F.col("feature") == "exon", F.struct("start", "end"))), lambda x: x.isNotNull()))
    g = feats.groupBy("seqname", group, "strand").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min(F.when(is_cds, F.col("start"))).alias("cs"), F.max(F.when(is_cds, F.col("end"))).alias("ce"), exons.alias("x"))
    join = lambda f: F.concat(F.array_join(F.transform("x", f), ","), F.lit(","))
    return g.select(F.concat_ws("\t", group, "seqname", "strand", (F.col("s") - 1).cast("string"), F.col("e").cast("string"), F.coalesce(F.col("cs") - 1, F.col("e")).cast("string"), F.coalesce("ce", "e").cast("string"), F.size("x").cast("string"), join(lambda x: (x["start"] - 1).cast("string")), join(lambda x: x["end"].cast("string"))).alias("value"))


def wig_lines(feats: DataFrame) -> DataFrame:
    """Fixed steps: runs of abutting rows of one length under a header of their own, in order."""
    w = Window.partitionBy("seqname").orderBy("start")
    span = F.col("end") - F.col("start") + 1
    new = F.lag("end").over(w).isNull() | (F.col("start") != F.lag("end").over(w) + 1) | (span != F.lag(span).over(w))
    head = F.concat(F.lit("fixedStep chrom="), "seqname", F.lit(" start="), "start", F.lit(" step="), span, F.when(span > 1, F.concat(F.lit(" span="), span)).otherwise(F.lit("")), F.lit("\n"))
    return feats.withColumn("_new", new).orderBy("seqname", "start").select(F.concat(F.when(F.col("_new"), head).otherwise(""), F.format_string("%.4f", F.col("score").cast("double"))).alias("value"))


def write(text: DataFrame, path: str) -> None:
    """Lines as text files."""
    text.write.text(path)
