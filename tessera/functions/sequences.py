"""Scalar functions on strings and sequences, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The standard genetic code, codons in TCAG order.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
#: Ambiguity codes.
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
IUPAC_OF = {frozenset(v): k for k, v in IUPAC.items()}


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def reverse_complement_segment(s: Column, start: int, end: int) -> Column:
    """The text with positions start..end (1-based) replaced by their reverse complement."""
    n = end - start + 1
    return F.concat(F.substring(s, 1, start - 1), reverse_complement(F.substring(s, start, n)), F.substring(s, end + 1, 2**31 - 1))


def translate_codons(s: Column) -> Column:
    """Amino acids of the whole codons; unknown codons give X, gaps of three give '-'."""
    table = F.create_map(*[F.lit(x) for kv in {**CODONS, "---": "-"}.items() for x in kv])
    starts = F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1)), F.lit(3))
    codons = F.transform(F.filter(starts, lambda i: i + 2 <= F.length(s)), lambda i: F.coalesce(F.element_at(table, F.upper(F.substr(s, i, F.lit(3)))), F.lit("X")))
    return F.array_join(codons, "")


def gc_content(s: Column) -> Column:
    """(G + C) / (A + C + G + T) of the upper-case letters; null without any."""
    gc = F.length(s) - F.length(F.translate(s, "GC", ""))
    all_ = F.length(s) - F.length(F.translate(s, "ACGT", ""))
    return F.when(all_ > 0, gc / all_)


def has_lowercase(s: Column) -> Column:
    return s.rlike("[a-z]")


def is_transition(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.greatest(a, b)).isin("AG", "CT")


def is_indel(a: Column, b: Column) -> Column:
    return (a == "-") != (b == "-")


def base_index(s: Column, alphabet: str = "ACGT") -> Column:
    """Place in the alphabet, -1 for others."""
    return F.instr(F.lit(alphabet), s) - 1


def kmer_code(s: Column, k: int, alphabet: str = "ACGT") -> Column:
    """The k-mer read as a number in the alphabet's base; -1 if it has other letters."""
    digits = [F.instr(F.lit(alphabet), F.substring(s, i + 1, 1)) - 1 for i in range(k)]
    value, bad = F.lit(0).cast("long"), F.lit(False)
    for d in digits:
        value, bad = value * len(alphabet) + d, bad | (d < 0)
    return F.when(bad | (F.length(s) != k), F.lit(-1)).otherwise(value)


def kmer_codes(s: Column, k: int, alphabet: str = "ACGT") -> Column:
    """The codes of the k-mers at all positions of a string, as an array; linear in its length: k shifted digit arrays are zipped."""
    digits = F.transform(F.split(s, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("long"))
    out = digits
    for shift in range(1, k):
        out = F.zip_with(out, F.slice(digits, shift + 1, F.length(s)), lambda v, d: F.when((v < 0) | (d < 0), F.lit(-1).cast("long")).otherwise(v * len(alphabet) + d))
    return F.slice(out, 1, F.greatest(F.length(s) - k + 1, F.lit(0)))


def kmer_counts(rows: DataFrame, text: Column, k: int, alphabet: str = "ACGT", most: int = 1 << 20) -> DataFrame:
    """code and n: how often each of kmer_codes is found in all texts.

    Texts are read side by side, some megabyte at a time, and each task adds up its counts before anything is shuffled.
    """
    if not alphabet.isascii():
        raise ValueError("letters of the alphabet have to be ASCII")
    digit = np.full(256, -1, np.int64)
    digit[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    size = len(alphabet) ** k + 1

    def codes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lead = (raw & 0xC0) != 0x80  # one byte for each character
        at = np.concatenate([[0], np.cumsum(lead)])[ends]
        x = digit[raw[lead]]
        n = max(len(x) - k + 1, 0)
        out, bad, inside = np.zeros(n, np.int64), np.zeros(n, bool), np.ones(len(x), bool)
        for i in range(k):
            out = out * len(alphabet) + x[i : i + n]
            bad |= x[i : i + n] < 0
        for i in range(1, k):  # a text's last characters begin none
            last = at[1:] - i
            inside[last[last >= at[:-1]]] = False
        out[bad] = -1
        return out[inside[:n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size if size <= most else 0, np.int64)
        for batch in batches:
            held = batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
            raw = np.frombuffer(held.buffers()[2] or b"", np.uint8)
            a = 0
            while a < len(held):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 20), "right")) - 1)
                found = codes(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                if len(total):
                    total += np.bincount(found + 1, minlength=size)
                else:
                    value, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"code": pa.array(value), "n": pa.array(n.astype(np.int64))})
                a = b
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(there - 1), "n": pa.array(total[there])})

    texts = rows.select(text.alias("_t")).filter(F.col("_t").isNotNull())
    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def kmer_of(code: Column, k: int, alphabet: str = "ACGT") -> Column:
    n = len(alphabet)
    return F.concat(*[F.substr(F.lit(alphabet), (F.floor(code / n**i) % n + 1).cast("int"), F.lit(1)) for i in range(k - 1, -1, -1)])


def mask_low_quality(s: Column, quality: Column, cutoff: int) -> Column:
    """Bases whose quality digit is at or below the cutoff become N."""
    marks = F.zip_with(F.split(s, ""), F.split(quality, ""), lambda b, q: F.when(q.cast("int") <= cutoff, "N").otherwise(b))
    return F.array_join(marks, "")


# -- plain strings -----------------------------------------------------------------------------------------------------


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, r"[\s]+$", "")


def trim_both(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def remove_whitespace(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", "")


def remove_quotes(s: Column) -> Column:
    return F.regexp_replace(s, "^[\"']|[\"']$", "")


def split_nonempty(s: Column, delimiters: str) -> Column:
    """Parts between any of the delimiters, without empty ones."""
    return F.filter(F.split(s, f"[{delimiters}]"), lambda x: x != "")


def split_quoted(s: Column, delimiter: str = " ") -> Column:
    """Parts between delimiters outside double quotes."""
    return F.filter(F.split(s, rf'{delimiter}(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: x != "")


def as_int(s: Column) -> Column:
    return s.try_cast("long")


def as_double(s: Column) -> Column:
    return s.try_cast("double")


def starts_with(s: Column, prefix: str) -> Column:
    return F.startswith(s, F.lit(prefix))


def ends_with(s: Column, suffix: str) -> Column:
    return F.endswith(s, F.lit(suffix))


def regex_groups(s: Column, pattern: str, groups: int) -> Column:
    """Captured groups of a match from the start; null without one."""
    return F.when(s.rlike(f"^(?:{pattern})"), F.array(*[F.regexp_extract(s, f"^(?:{pattern})", i) for i in range(groups + 1)]))


def regex_position(s: Column, pattern: str) -> Column:
    """0-based place of the first match, -1 without one."""
    return F.regexp_instr(s, F.lit(pattern)) - 1


def root(s: Column, delimiter: str = ".") -> Column:
    """What stands before the last delimiter."""
    return F.regexp_replace(s, rf"\{delimiter}[^{delimiter}]*$", "")


def shortest_root(s: Column, delimiter: str = ".") -> Column:
    return F.substring_index(s, delimiter, 1)


def suffix(s: Column, delimiter: str = ".") -> Column:
    return F.when(F.instr(s, delimiter) > 0, F.substring_index(s, delimiter, -1)).otherwise("")


def basename(s: Column) -> Column:
    return F.substring_index(s, "/", -1)


def index_of(s: Column, char: str) -> Column:
    return F.instr(s, char) - 1


def equals_nocase(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)
