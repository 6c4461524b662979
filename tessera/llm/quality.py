"""Quality rules by tokeniser fertility.

Public vocabularies are taken for yardsticks of ordinary text: one of pieces with byte fallback, and one of byte pairs
for many languages. Per document the ids of each give the characters per token, the share of tokens that are bytes or parts of
characters, and the entropy of the tokens (in bits, over the most that so many tokens can have). Shouting, sign spam, tables
and encoded data break into more tokens than the prose of their language, and repeat more of them. For every group (language, else
the main script of the text) the centre and spread of each measure come from all its documents, as a median and a median
deviation over counted bins, which merge exactly in any order. Entropy falls with a text's length, so it is compared
only with texts of the group whose number of tokens has as many bits. A document is rejected when its characters per
token lie outside the group's band by both vocabularies, or its byte share or entropy by one; the base rules (too few
words, too many repeated windows) reject as well. A group of any size is judged by its own bands, which are the wider the fewer
documents they come from.

Defined results: a null text has no words and fails the base rules; a null language falls to the script's group; texts
are measured whole, however long; repeated rows are judged alike; ties in a median go to the lower bin; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bytepairs import BytePairs
from tessera.llm.common import KEPT, WORD, broadcast_if_small, map_slices, pick, texts_of
from tessera.llm.spm import public_path
from tessera.runtime import stage

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x6FF), "indic": (0x900, 0xDFF), "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF)}
PAIRS = "byte_bpe_multi_50k.tiktoken"
#: Each vocabulary's measures: by pieces, and by byte pairs.
CHARS = ("chars_per_token", "chars_per_token_pairs")
BYTES = ("byte_share", "byte_share_pairs")
ENTROPY = ("entropy", "entropy_pairs")
TOKENS = ("n_tokens", "n_tokens_pairs")
MEASURES = (*CHARS, *BYTES, *ENTROPY)


@dataclass(frozen=True)
class Bands:
    """Production limits, in median deviations from the group's median (a least deviation guards uniform groups;
    texts of fewer than steady_words words get wider bands of characters and bytes, and bands from n documents are
    1 + few / n times as wide)."""

    low_chars: float = 8.0
    high_chars: float = 6.0
    high_bytes: float = 3.0
    low_entropy: float = 3.0
    least_chars: float = 0.03
    least_bytes: float = 0.02
    least_entropy: float = 0.02
    steady_words: int = 150
    few: float = 5.0
    min_words: int = 50
    repeat_percent: int = 50


@lru_cache(maxsize=1)
def vocabularies(pieces: str, pairs: str) -> list[tuple]:
    """For both vocabularies: a function from a text to its ids, and which ids are bytes or parts of characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    coder = BytePairs(pairs)
    partial = np.zeros(len(coder.tokens), bool)
    for rank, token in enumerate(coder.tokens):
        try:
            token.decode()
        except UnicodeDecodeError:
            partial[rank] = True
    return [(model.encode, np.array([model.is_byte(i) for i in range(model.get_piece_size())])), (coder.encode, partial)]


KEPT["vocabularies"] = vocabularies.cache_clear


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    k = len(seen)
    if k > 2_000_000:  # three ids would not fit into 64 bits
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * k + ids[2:]
    else:
        keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for at in range(3):
        covered[at : n - 2 + at] |= again
    return int(covered.sum())


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    counts = {name: int(((points >= a) & (points <= b)).sum()) for name, (a, b) in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "none"


def measures_of(text: str, vocabulary: tuple) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of bytes and parts of characters, and entropy of a text in a vocabulary."""
    encode, partial = vocabulary
    ids = np.array(encode(text), np.int64)
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 1.0
    counts = np.unique(ids, return_counts=True)[1]
    bits = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
    return n, len(text) / n, float(partial[ids].mean()), bits / float(np.log2(n)) if n > 1 else 1.0


def measure(docs: DataFrame, path: str | None = None, pairs_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: dict | None = None, text_as: str | None = None) -> DataFrame:
    """The base counts and both vocabularies' measures of every row; `keep` adds columns of docs under new names, text_as the text."""
    path, pairs_path = path or public_path(), pairs_path or public_path(PAIRS)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        both = vocabularies(path, pairs_path)
        out: dict[str, list] = {k: [] for k in ("group_name", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *TOKENS, *MEASURES)}
        for text, lang in zip(texts_of(part, "text"), part.column("lang").to_pylist()):
            words = WORDS.findall(text)
            lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            out["group_name"].append(f"lang:{lang}" if lang is not None else f"script:{script_of(text)}")
            out["n_words"].append(len(words))
            out["word_chars"].append(sum(map(len, words)))
            out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
            out["n_dup_lines"].append(len(lines) - len(set(lines)))
            out["n_repeat_words"].append(repeated_words(words))
            for vocabulary, names in zip(both, zip(TOKENS, CHARS, BYTES, ENTROPY)):
                for name, value in zip(names, measures_of(text, vocabulary)):
                    out[name].append(value)
        names = [x for x in part.schema.names if x not in ("text", "lang")]
        whole = [part.column("text")] if text_as else []
        return pa.RecordBatch.from_arrays([*[part.column(x) for x in names], *whole, *[pa.array(v) for v in out.values()]], [*names, *[text_as] * len(whole), *out])

    slim = pick(docs, doc_id=id_col, text=F.col(text_col).cast("string"), lang=F.col(lang_col).cast("string"), **(keep or {}))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name not in ("text", "lang"))
    fields += f", `{text_as}` string" if text_as else ""
    numbers = ", ".join([f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *TOKENS)] + [f"{c} double" for c in MEASURES])
    return map_slices(slim, "text", run, f"{fields}, group_name string, {numbers}", uses="vocabularies")


def _binned_median(df: DataFrame, value, name: str) -> DataFrame:
    """group_name, band, the median of `value`, to a 1/512 of the unit, by counting bins (partial counts merge in any order), and _docs."""
    counted = df.groupBy("group_name", "band", F.round(value * 512).cast("long").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("group_name", "band")
    ranked = counted.withColumn("_sum", F.sum("_n").over(w.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(w))
    return ranked.filter(2 * F.col("_sum") >= F.col("_all")).groupBy("group_name", "band").agg((F.min("_bin") / 512).alias(name), F.max("_all").alias("_docs"))


def _band(name: str):
    """What a measure of a row is compared with: all of the group, or for entropy those with as many bits of tokens."""
    bits = dict(zip(ENTROPY, TOKENS))
    return F.concat(F.lit(f"{name}:"), F.length(F.bin(bits[name])).cast("string")) if name in bits else F.lit(name)


def bands_of(measured: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """group_name and bands: for each band's name its mid, dev and docs, over all documents that pass the base rules."""
    sound = measured.filter(~base_failed(bands))
    each = sound.select("group_name", F.explode(F.array(*[F.struct(_band(m).alias("band"), F.col(m).alias("value")) for m in MEASURES])).alias("_x")).select("group_name", "_x.band", "_x.value")
    mids = stage(_binned_median(each, F.col("value"), "mid"), "quality-centres")
    apart = each.join(broadcast_if_small(mids.drop("_docs")), ["group_name", "band"])
    spread = _binned_median(apart.withColumn("_d", F.abs(F.col("value") - F.col("mid"))), F.col("_d"), "dev").drop("_docs")
    whole = mids.join(spread, ["group_name", "band"])
    return stage(whole.groupBy("group_name").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("mid", "dev", F.col("_docs").alias("docs"))))).alias("bands")), "quality-bands")


def base_failed(bands: Bands = Bands()):
    return (F.col("n_words") < bands.min_words) | (100 * F.col("n_repeat_words") > bands.repeat_percent * F.col("n_words"))


def judge(measured: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """`measured` (staged, as it is read twice) with base_failed, kept and, for those that go, reason."""
    found = bands_of(measured, bands).withColumnRenamed("group_name", "_group")
    rows = measured.join(broadcast_if_small(found), F.col("group_name") == F.col("_group"), "left")
    # a mean over fewer words strays further, by the square root
    short = F.sqrt(F.greatest(F.lit(1.0), bands.steady_words / F.greatest(F.col("n_words"), F.lit(1))))

    def apart(m: str, least: float):
        band = F.element_at("bands", _band(m))
        return (F.col(m) - band["mid"]) / (F.greatest(band["dev"], F.lit(least)) * (1 + bands.few / band["docs"]))

    chars, bytes_, entropy = ([apart(m, least) / wider for m in names] for names, least, wider in ((CHARS, bands.least_chars, short), (BYTES, bands.least_bytes, short), (ENTROPY, bands.least_entropy, F.lit(1.0))))
    reason = (
        F.when(base_failed(bands), "base")
        .when(F.greatest(*chars) < -bands.low_chars, "few_chars_per_token")
        .when(F.least(*chars) > bands.high_chars, "many_chars_per_token")
        .when(F.greatest(*bytes_) > bands.high_bytes, "byte_fallback")
        .when(F.least(*entropy) < -bands.low_entropy, "low_entropy")
    )
    return rows.withColumn("reason", reason).withColumn("base_failed", base_failed(bands)).withColumn("kept", F.col("reason").isNull()).drop("_group", "bands")


def quality(docs: DataFrame, path: str | None = None, bands: Bands = Bands(), **columns) -> DataFrame:
    return judge(stage(measure(docs, path, **columns), "quality-measures"), bands)


def keep_sound(docs: DataFrame, path: str | None = None, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that pass both the base rules and the bands."""
    kept = {f"_keep_{c}": docs[c] for c in docs.columns if c != "text"}
    return quality(docs, path, bands, keep=kept, text_as="_keep_text").filter("kept").select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])


def op6_tokeniser_fertility(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason", *MEASURES)
