"""Katz backoff language model over whole texts.

The probability of a word after its history is the discounted share of their n-gram, where that was seen often enough,
else the history's backoff weight times the probability after the shorter history. Discounts follow Good-Turing for
counts up to `most` and are one beyond; backoff weights share out exactly what the discounts leave: for every history
the probabilities of all known words, the end and one unknown word add up to one.

Texts are packed into blocks of words (64-bit names) once. For each order the blocks ask a table that is partitioned by
n-gram for the counts in all training texts (exchange.py); each distinct n-gram has one owner among its blocks, whose
sums of discounted counts and of lower-order probabilities meet by history and come back as backoff weights. An n-gram is
only asked for where its history and its shorter n-gram were seen as often as the order's least count demands, as none
else can be in the table. Each block then evaluates its n-grams from the shortest to the longest and adds up by text.

Defined results: a null or empty text is its end alone; a null id is held out; repeated rows count, and are scored, each
time; very long texts are one block each; an empty table gives an empty result; without training texts both scores are 0;
other columns are not read. Where an order's counts give no Good-Turing discount between 0 and 1, every count up to `most`
loses a half; a history all of whose n-grams keep their whole counts has 1 added to its total. Words have 64-bit names
(XXH64), n-grams mixes of these; two among 10^9 words share one with a chance of 3 %.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange
from tessera.llm.common import drop_kept, pick, slices
from tessera.runtime import stage, stage_by, unstage

#: Names that no word has: a text's end, which is predicted, and its begin, which is only a history.
END = xxhash.xxh64_intdigest(b"")
BEGIN = xxhash.xxh64_intdigest(b" ")
ADDED = 0.1
#: Lower probabilities are added up in whole parts of this one: exact in any order, and short to send.
PART = 2.0**-48
#: Bytes of text in a block: a worker holds some twenty numbers for each of its tokens.
SLICE_BYTES = 3 << 20
BLOCK_DDL = "doc_id array<{kind}>, held array<boolean>, ends binary, words binary, tokens binary"


@dataclass(frozen=True)
class Katz:
    """least: for each order the least count of an n-gram in the table (rising, 1 first); most: the largest discounted count."""

    least: tuple[int, ...] = (1, 1, 2)
    most: int = 5

    def __post_init__(self):
        if not self.least or self.least[0] != 1 or list(self.least) != sorted(self.least) or self.most < max(self.least):
            raise ValueError("least counts have to rise from 1 and may not exceed `most`")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For all texts one after another: the words' places among the distinct ones, where each text ends, and the distinct words."""
    whole = pa.concat_arrays([texts, texts.slice(0, 0)])  # a copy from offset 0: lower-casing misreads cast parts of a longer array
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole, "").cast(pa.large_string())))
    bounds = lists.offsets.to_numpy()
    coded = lists.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).dictionary_encode()
    places, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    if "" in distinct:  # what stands before the first and after the last space of a text
        at = distinct.index("")
        there = places != at
        counts = np.concatenate([[0], np.cumsum(there)])
        places, bounds = places[there], counts[bounds - bounds[0]]
        places = places - (places > at)
        distinct.pop(at)
    else:
        bounds = bounds - bounds[0]
    return places.astype(np.int64), bounds[1:].astype(np.int64), distinct


def packed(part: pa.RecordBatch) -> tuple:
    """The fields of a block: its ids, which are held out, where texts end, sorted names of words, and all texts' tokens with their ends."""
    places, ends, distinct = words_of(part.column("text"))
    names = np.array([xxhash.xxh64_intdigest(w.encode()) for w in distinct] + [END], np.uint64)
    words, back = np.unique(names, return_inverse=True)
    n, texts = len(places), len(ends)
    tokens = np.full(n + texts, back[-1], np.uint64)
    inside = np.ones(n + texts, bool)
    ends = ends + np.arange(texts) + 1
    inside[ends - 1] = False
    tokens[inside] = back[places]
    return part.column("doc_id").to_pylist(), part.column("held").to_pylist(), exchange.pack_keys(ends.astype(np.uint64)), exchange.pack_keys(words), exchange.squeezed(exchange.pack(tokens)), n + texts


def blocks_of(docs: DataFrame, held: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, n_bytes and the packed fields; held: SQL over doc_id that tells which texts are not learned from."""
    slim = pick(docs, doc_id=id_col, text=F.col(text_col).cast("string"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    slim = slim.withColumn("held", F.coalesce(F.expr(held), F.lit(True)))
    fields = f"block long, n_bytes long, n_tokens long, {BLOCK_DDL.format(kind=kind)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(None)
        count = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, out, ends, words, tokens, n = packed(part)
                size = part.column("text").nbytes
                arrays = [pa.array([next(count)]), pa.array([size]), pa.array([n]), pa.array([ids], pa.list_(part.column("doc_id").type)), pa.array([out], pa.list_(pa.bool_())), *[pa.array([x], pa.binary()) for x in (ends, words, tokens)]]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "n_bytes", "n_tokens", "doc_id", "held", "ends", "words", "tokens"])

    return slim.mapInArrow(run, fields)


class Block:
    """A block's n-grams: `gram[n]` has the n-gram that ends at each place of the joined texts, begins included, or -1."""

    def __init__(self, row: dict):
        self.ends = exchange.unpack_keys(row["ends"]).astype(np.int64)
        words = exchange.unpack_keys(row["words"])
        tokens = exchange.unpack(exchange.expanded(row["tokens"])).astype(np.int32)
        texts = len(self.ends)
        starts = (np.concatenate([[0], self.ends[:-1]]) + np.arange(texts)).astype(np.int64)
        self.starts = starts  # the places of the begins
        begins = np.zeros(len(tokens) + texts, bool)
        begins[starts] = True
        self.predicted = ~begins
        line = np.full(len(begins), len(words), np.int32)
        line[self.predicted] = tokens
        sizes = np.diff(np.concatenate([starts, [len(begins)]]))
        self.depth = (np.arange(len(begins)) - np.repeat(starts, sizes)).astype(np.int32)
        self.trained = np.repeat(~np.array(row["held"], bool), sizes)
        self.gram = {1: line}
        self.keys = {1: np.concatenate([words, [np.uint64(BEGIN)]])}
        self.history: dict[int, np.ndarray] = {}
        self.shorter: dict[int, np.ndarray] = {}

    def reach(self, order: int) -> Block:
        """Builds the n-grams up to an order."""
        for n in range(max(self.gram) + 1, order + 1):
            at = np.flatnonzero(self.depth >= n - 1)
            width = len(self.keys[1])
            place, both = pd.factorize(self.gram[n - 1][at - 1].astype(np.int64) * width + self.gram[1][at])
            self.gram[n] = np.full(len(self.depth), -1, np.int32)
            self.gram[n][at] = place
            history, last = np.divmod(both, width)
            self.history[n] = history.astype(np.int32)
            self.shorter[n] = np.zeros(len(both), np.int32)
            self.shorter[n][place] = self.gram[n - 1][at]
            self.keys[n] = exchange.mix(self.keys[n - 1][history], self.keys[1][last])
        return self

    def counts(self, n: int) -> np.ndarray:
        there = self.trained & (self.gram[n] >= 0)
        return np.bincount(self.gram[n][there], minlength=len(self.keys[n])).astype(np.uint64)


class Evaluation:
    """What a block knows after the answers of some orders: counts, owned n-grams and backoff weights."""

    def __init__(self, row: dict, model: Katz, stats: dict[int, Stats]):
        self.model, self.stats = model, stats
        self.block = Block(row)
        self.count: dict[int, np.ndarray] = {}
        self.own: dict[int, np.ndarray] = {}
        self.p: dict[int, np.ndarray] = {}
        for n in sorted(stats):
            self._counted(n, row[f"a{n}"] or [])
            if n > 1 and f"a{n + 1}" in row:
                self._weighed(n, row[f"a{n + 1}"] or [])

    def asked(self, n: int) -> np.ndarray:
        """The n-grams that may be in the table, in the order of their keys."""
        keys = self.block.reach(n).keys[n]
        if n == 1:
            return np.argsort(keys)
        least = self.model.least[n - 1]
        maybe = (self.count[n - 1][self.block.history[n]] >= least) & (self.count[n - 1][self.block.shorter[n]] >= least)
        found = np.flatnonzero(maybe)
        return found[np.argsort(keys[found])]

    def histories(self, n: int) -> np.ndarray:
        """The (n-1)-grams whose weight, total or sums this block asks for or tells of, in the order of their keys.

        These may be histories in the table, and have an n-gram here that is not in it or that this block owns, or a count that
        may hide that all their n-grams keep their whole counts.
        """
        h, stored = self.block.history[n], self.count[n] >= self.model.least[n - 1]
        wanted = self.count[n - 1] > self.model.most
        wanted[h[~stored | self.own[n]]] = True
        found = np.flatnonzero(wanted & (self.count[n - 1] >= self.model.least[n - 1]))
        return found[np.argsort(self.block.keys[n - 1][found])]

    def _counted(self, n: int, answers: list) -> None:
        asked = self.asked(n)
        got = np.concatenate([exchange.unpack(x["counts"]) for x in answers]) if answers else np.zeros(0, np.uint64)
        for store, values, kind in ((self.count, got >> np.uint64(1), np.int64), (self.own, got & np.uint64(1), bool)):
            store[n] = np.zeros(len(self.block.keys[n]), kind)
            store[n][asked] = values.astype(kind)
        if n == 1:
            unknown = self.stats[1].unknown()
            d = self.stats[1].discounted(self.count[1])
            self.p[1] = np.where(self.count[1] > 0, d / self.stats[1].whole(), unknown)

    def _weighed(self, n: int, answers: list) -> None:
        histories = self.histories(n)
        found = np.concatenate([exchange.doubles(x["weights"]) for x in answers]) if answers else np.zeros(0)
        total = self.count[n - 1].astype(np.float64)
        total[histories] += found < 0
        weight = np.ones(len(total))
        weight[histories] = np.abs(found)
        d = self.stats[n].discounted(self.count[n])
        h = self.block.history[n]
        self.p[n] = np.where(d > 0, d / np.maximum(total[h], 1), weight[h] * self.p[n - 1][self.block.shorter[n]])

    def sums(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys and counts of histories, and over the n-grams that this block owns the sums of discounted counts and lower probabilities."""
        d = self.stats[n].discounted(self.count[n])
        mine = np.flatnonzero(self.own[n] & (d > 0))
        h, size = self.block.history[n][mine], len(self.block.keys[n - 1])
        kept = np.bincount(h, d[mine], size)
        lower = exchange.sums(h, np.round(self.p[n - 1][self.block.shorter[n][mine]] / PART), size)
        histories = self.histories(n)
        totals = np.where(kept > 0, self.count[n - 1], 0)  # with the sums: where there are none the weight is 1
        return self.block.keys[n - 1][histories], totals[histories], kept[histories], lower[histories]


@dataclass(frozen=True)
class Stats:
    """An order's discounts, with the number of different n-grams, the sum of their counts and how many have each small count."""

    least: int
    most: int
    distinct: int
    total: int
    seen: tuple[int, ...]  # n-grams with the counts 1 to most + 1

    def shares(self) -> np.ndarray:
        """What of a count from 0 to `most` is kept."""
        r = np.arange(self.least, self.most + 1)
        n = np.array((0, *self.seen), np.float64)
        out = np.zeros(self.most + 1)
        kept = np.full(len(r), -1.0)
        if n[r].all() and n[self.most + 1]:
            turing = (r + 1) * n[r + 1] / (r * n[r])
            common = (self.most + 1) * n[self.most + 1] / (self.least * n[self.least])
            kept = (turing - common) / (1 - common) if common < 1 else kept
        out[r] = kept if ((kept > 0) & (kept < 1)).all() else (r - 0.5) / r
        return out

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= self.most, self.shares()[np.minimum(counts, self.most)], 1.0)

    def whole(self) -> int:
        """What words' counts are parts of."""
        return self.total + (not any(self.seen[: self.most]))

    def unknown(self) -> float:
        lost = sum(n * r * (1 - kept) for r, n, kept in zip(range(1, self.most + 1), self.seen, self.shares()[1:]))
        return (lost + self.whole() - self.total) / self.whole()


ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("histories", pa.binary()), ("totals", pa.binary()), ("kept", pa.binary()), ("lower", pa.binary())])
ANSWER = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("weights", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64()), ("seen", pa.list_(pa.int64()))])
ASKED_DDL = "bucket int, block long, keys binary, counts binary, histories binary, totals binary, kept binary, lower binary"
ANSWER_DDL = "bucket int, block long, counts binary, weights binary, distinct long, total long, seen array<long>"


def _ask(known: DataFrame, n: int, model: Katz, stats: dict[int, Stats], bits: int) -> DataFrame:
    """Round n: asks for the counts of the n-grams and, with its sums, for the weights of the histories one order below."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for row in _rows(batches):
            e = Evaluation(row, model, stats)
            out: dict[int, list] = {}
            if n <= len(model.least):
                asked = e.asked(n)
                keys, counts = e.block.keys[n][asked], e.block.counts(n)[asked]
                for bucket, at in exchange.parts(keys, bits):
                    out.setdefault(bucket, [None] * 6)[:2] = exchange.pack_keys(keys[at]), exchange.pack(counts[at])
            if n > 2:
                keys, totals, kept, lower = e.sums(n - 1)
                for bucket, at in exchange.parts(keys, bits):
                    out.setdefault(bucket, [None] * 6)[2:] = exchange.pack_keys(keys[at]), exchange.squeezed(exchange.pack(totals[at])), exchange.pack_doubles(kept[at]), exchange.squeezed(exchange.pack(lower[at]))
            for bucket, fields in out.items():
                yield bucket, row["block"], *fields

    return known.mapInArrow(lambda batches: exchange.in_batches(rows(batches), ASKED), ASKED_DDL)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    drop_kept(None)
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _answer(n: int, most: int):
    """Adds up the counts of a bucket's n-grams and what the blocks found of its histories, whose weights are negative where 1 was added to the total."""

    def run(rows: list[dict]) -> Iterator[tuple]:
        distinct, place, first, ends = exchange.meet([exchange.unpack_keys(r["keys"]) for r in rows])
        counts = exchange.sums(place, np.concatenate([exchange.unpack(r["counts"]) for r in rows]), len(distinct)) if len(place) else np.zeros(0, np.uint64)
        real = counts[(distinct != np.uint64(BEGIN)) & (counts > 0)] if n == 1 else counts[counts > 0]
        seen = np.bincount(np.minimum(real, np.uint64(most + 2)).astype(np.int64), minlength=most + 3)[1 : most + 2].tolist()
        coded = counts[place] << np.uint64(1)
        coded[first] |= np.uint64(1)
        names, at, _, stops = exchange.meet([exchange.unpack_keys(r["histories"]) for r in rows])
        weights = np.zeros(0)
        if len(at):
            kept = np.bincount(at, np.concatenate([exchange.doubles(r["kept"]) for r in rows]), len(names))
            lower = exchange.sums(at, np.concatenate([exchange.unpack(exchange.expanded(r["lower"])) for r in rows]), len(names)) * PART
            total = np.zeros(len(names))
            np.maximum.at(total, at, np.concatenate([exchange.unpack(exchange.expanded(r["totals"])) for r in rows]).astype(np.float64))
            whole = (kept >= total) & (total > 0)
            total[total == 0] = 1
            weights = ((1 - kept / (total + whole)) / np.maximum(1 - lower, np.finfo(float).tiny) * np.where(whole, -1.0, 1.0))[at]
        yield rows[0]["bucket"], None, None, None, len(real), int(real.sum()), seen
        for i, r in enumerate(rows):
            yield r["bucket"], r["block"], exchange.pack(coded[ends[i] : ends[i + 1]]), exchange.pack_doubles(weights[stops[i] : stops[i + 1]]), None, None, None

    return run


def evaluated(docs: DataFrame, held: str = "false", model: Katz = Katz(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    held: SQL over doc_id; texts for which it is true or null are scored, not learned from. base_score adds 0.1 to
    every word's count; score is the model's log10 probability of the text and its end.
    """
    blocks = stage_by(blocks_of(docs, held, id_col, text_col), "katz-blocks", "block")
    text_bytes = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = exchange.bucket_bits(text_bytes)
    stats: dict[int, Stats] = {}
    known, orders = blocks, len(model.least)
    for n in range(1, orders + 2):
        asked = _ask(known, n, model, dict(stats), bits)
        table = stage(exchange.answered(asked, _answer(n, model.most), ANSWER, ANSWER_DDL), f"katz-{n}-grams")
        if n <= orders:
            of_buckets = table.filter(F.col("block").isNull())
            found = of_buckets.agg(F.sum("distinct"), F.sum("total"), *[F.sum(F.col("seen")[r]) for r in range(model.most + 1)]).first()
            stats[n] = Stats(model.least[n - 1], model.most, found[0] or 0, found[1] or 0, tuple(x or 0 for x in found[2:]))
        if n == orders + 1 or orders == 1:
            known = known.join(exchange.by_block(table, "counts", "weights", name=f"a{n}"), "block", "left")
            break
        # the answers lie as the blocks do: no later round shuffles either
        answers = stage_by(exchange.by_block(table, "counts", "weights", name=f"a{n}"), f"katz-answers-{n}", "block", together=True)
        unstage(table)
        known = known.join(answers, "block", "left")
    return _scores(known, model, stats, docs, id_col)


def _scores(known: DataFrame, model: Katz, stats: dict[int, Stats], docs: DataFrame, id_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    n_train, n_words = stats[1].total, stats[1].distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, row in enumerate(_rows(iter([batch]))):
                e = Evaluation(row, model, stats)
                b, line = e.block, e.block.gram[1]
                p = e.p[1][line]
                for n in range(2, len(model.least) + 1):
                    there = b.gram[n] >= 0
                    p[there] = e.p[n][b.gram[n][there]]
                known_words = (e.count[1][line] > 0) & b.predicted
                base = np.where(b.predicted, np.log10((e.count[1][line] + ADDED) / (n_train + ADDED * (n_words + 1))), 0.0)
                score = np.log10(p, where=b.predicted, out=np.zeros(len(p)))
                sizes = np.diff(np.concatenate([b.starts, [len(line)]])) - 1
                columns = [ids[i].values, pa.array(row["held"]), pa.array(sizes, pa.int64()), *[pa.array(np.add.reduceat(x, b.starts)) for x in (known_words.astype(np.int64),)], pa.array(np.full(len(sizes), n_train, np.int64)), *[pa.array(np.add.reduceat(x, b.starts)) for x in (base, score)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return known.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


#: Texts that op13 scores without learning from them.
HELD_OUT = "crc32(cast(doc_id AS string)) % 10 = 0"


def op13_katz_backoff(spark, sf_dir: str) -> DataFrame:
    return evaluated(spark.read.parquet(f"{sf_dir}/documents.parquet"), HELD_OUT)
