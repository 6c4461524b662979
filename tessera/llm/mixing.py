"""Mixing sources to target weights, in DataFrame operations only.

Sources in code point order (null last) get weights in turn; the targets share all words by weight, but none may pass
`most` times its source's words: what is over is shared again by weight among the others until none is above. Inside
a source every document gets a pseudo-random key (the MD5 of seed and id); rows are range-sorted by source and key,
prefix sums of the words are added up over the partitions, and the mix takes whole epochs of the source and then the
first words of that order until the budget is met to the word. The document at the cut is taken in part.

Defined results: a null text has no words; a null source is a source of its own, last in order; repeated ids are
parted by size; rows without words are kept with taken = 0; a table without words has targets of 0; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, broadcast_if_small, numbered, pick
from tessera.runtime import stage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = "mix-1"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, budget (the target in whole words) for frames with (source, source_size), a row a source.

    The reshared targets have a closed form: with caps c and weights w, sources in the order of c / w are capped as
    long as the rest of the total, shared by the rest of the weights, gives them more than their cap; the others get
    the remaining total by weight. Both orders number the sources, of which there is one row each.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "_rank", partitions=1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.select("source", "source_size", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")).alias("_w"))
    weighed = weighed.withColumn("_cap", F.lit(most) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = [F.col("_ratio"), F.col("source").asc_nulls_last()]
    sums = numbered(weighed, order, "_place", {"_cap_before": "_cap", "_w_before": "_w"}, partitions=1)
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("_w"), F.lit(1.0)).alias("weight")).first()
    share = (F.lit(total["words"]) - F.col("_cap_before")) / (F.lit(total["weight"]) - F.col("_w_before"))
    out = stage(sums.withColumn("_share", share).withColumn("_capped", share * F.col("_w") > F.col("_cap")), "mix-shares")
    # the first source in order that is not capped sets the level of the rest
    level = out.filter(~F.col("_capped")).agg(F.min_by("_share", "_place").alias("level")).first()["level"] or 0.0
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.lit(level) * F.col("_w"))
    target = F.least(target, F.col("_cap").cast("double"))
    return out.select("source", "source_size", target.alias("target")).withColumn("budget", F.round("target").cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row; `keep` adds columns of docs under new names."""
    slim = pick(docs, doc_id=id_col, source=source_col, size=words_in(docs[text_col]), **(keep or {}))
    slim = stage(slim, "mix-sizes").withColumn("_key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size")]
    rows = numbered(slim, order, "_row", {"_before_all": "size"})
    sizes = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_before_all").alias("_first")), "mix-sources")
    targets = source_targets(sizes.select("source", "source_size"), weights, most)
    per = targets.join(sizes.select(F.col("source").alias("_s"), "_first"), F.expr("source <=> _s")).drop("_s").withColumnRenamed("source", "_source")
    joined = rows.join(broadcast_if_small(stage(per, "mix-targets")), F.expr("source <=> _source"))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_before_all") - F.col("_first"))))
    taken = (whole * F.col("size") + part).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *(keep or {}))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, once for every whole epoch, and the first words of those that the cut parts.

    Documents without words have nothing to be taken and are not in the mix; all other columns of docs come along
    unchanged, whatever their names, but n_chars, which follows the text.
    """
    kept = [docs[c].alias(f"_keep_{c}") for c in docs.columns]
    rows = stage(docs.select(*kept, F.monotonically_increasing_id().alias("_uid")), "mix-documents")
    found = mix(rows, weights, most, seed, id_col="_keep_doc_id", text_col="_keep_text", source_col="_keep_source", keep={"_uid": rows["_uid"]})
    taken = stage(found.filter("taken > 0").select(F.col("_uid").alias("_taken_uid"), F.col("size").alias("_size"), F.col("taken").alias("_taken")), "mix-taken")
    # texts move by one shuffle at any size, not by a broadcast while the taken rows are few
    met = rows.join(taken.hint("merge"), F.col("_uid") == F.col("_taken_uid"))
    met = met.withColumn("_whole", F.expr("_taken div _size")).withColumn("_part", F.expr("_taken % _size").cast("int"))
    each = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("_whole") + F.when(F.col("_part") > 0, 1).otherwise(0)).cast("int"))))
    pieces = F.regexp_extract_all("_keep_text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.when(F.col("_copy") <= F.col("_whole"), F.col("_keep_text")).otherwise(F.array_join(F.slice(pieces, 1, F.greatest(F.col("_part"), F.lit(1))), ""))
    out = each.withColumn("_keep_text", cut)
    out = out.withColumn("_keep_n_chars", F.length("_keep_text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
