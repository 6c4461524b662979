"""Alignment of two vocabularies' tokens over the same bytes.

Each text is a row of bytes that both tokenizers cut. Offsets where a token of both ends part it into groups; at each
such offset one token of A and one of B end together, which is a link. Pairs of ids that are linked often name what the
two vocabularies share.

Texts that are equal are aligned once: rows meet by their whole text, each distinct text is tokenised and aligned, and its
links count as often as the text occurs. Blocks of texts then ask for the corpus-wide counts of the id pairs in them
(exchange.py), and their measures are joined to all documents by the texts' SHA-256. What the driver holds is one
largest count for each id of B, which the vocabulary bounds.

Defined results: a null or empty text, and one whose joined token bytes of A or B are not a space and the text, has no tokens:
zeros and ''; texts of any length are aligned whole; rows with the same text, and repeated rows, get equal results, each
counting; a null id is kept; ties for a B id's highest count all count as highest; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange
from tessera.llm.bytepairs import BytePairs
from tessera.llm.common import KEPT, drop_kept, pick, slices
from tessera.llm.spm import public_path
from tessera.runtime import stage

#: The byte-pair vocabulary as ranks; its ids are those of byte_bpe_50k.json (the tests compare the two).
A_NAME, B_NAME = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
SLICE_BYTES = 1 << 20
PARTS_DDL = "block long, n_bytes long, keys array<binary>, copies array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, pairs binary, ends binary, links binary"


class Aligner:
    """Both vocabularies, the bytes of their ids and the pieces of a groups line."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = BytePairs(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        model = self.b
        self.a_bytes = self.a.tokens
        self.b_bytes = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            # no text has a byte FF, so that no text is one with unknown pieces
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"\xff" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.marks = [np.array([str(i) + mark for i in range(len(table))], object) for table, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks]

    def align(self, text: str, b_ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """The ids of both and, of each link, the places of its tokens; None where the bytes differ."""
        a = self.a.encode(" " + text)
        raw = (" " + text).encode()
        if b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw:
            return None
        b = np.array(b_ids, np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at = np.searchsorted(b_ends, a_ends)  # the last ends are equal
        last_a = np.flatnonzero(b_ends[at] == a_ends)
        return a.astype(np.int64), b, last_a, at[last_a]

    def line(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3` for the groups."""
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        out = np.empty(len(a) + len(b), object)
        for ids, last, size, shift, (inner, final) in ((a, last_a, size_a, np.concatenate([[0], last_b[:-1] + 1]), self.marks[:2]), (b, last_b, size_b, last_a + 1, self.marks[2:])):
            place = np.arange(len(ids)) + np.repeat(shift, size)
            out[place] = inner[ids]
            out[place[last]] = final[ids[last]]
        return "".join(out.tolist())[:-1]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


KEPT["aligner"] = aligner.cache_clear


def key_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return exchange.spread((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))


def pair_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = exchange.unspread(key)
    return both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)


def _aligned(distinct: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Blocks of distinct texts with their digests, measures and links, which are places in the block's sorted pair keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept("aligner")
        both = aligner(a_path, b_path)
        count = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = part.column("text").to_pylist()
                out: dict[str, list] = {k: [] for k in ("keys", "n_a", "n_b", "n_groups", "groups_sha256")}
                links, ends = [], []
                for text, b_ids in zip(texts, both.b.encode(texts, num_threads=1)):
                    found = both.align(text, b_ids)
                    a, b, last_a, last_b = found or (np.zeros(0, np.int64),) * 4
                    out["keys"].append(hashlib.sha256(text.encode()).digest())
                    out["n_a"].append(len(a))
                    out["n_b"].append(len(b))
                    out["n_groups"].append(len(last_a))
                    out["groups_sha256"].append(hashlib.sha256(both.line(*found).encode()).hexdigest() if found else "")
                    links.append(key_of(a[last_a], b[last_b]))
                    ends.append(len(last_a))
                pairs, places = np.unique(np.concatenate(links), return_inverse=True)
                one = [pa.array([next(count)]), pa.array([part.nbytes])]
                lists = [pa.array([out["keys"]], pa.list_(pa.binary())), pa.array([part.column("copies").to_pylist()], pa.list_(pa.int64())), *[pa.array([out[k]], pa.list_(pa.int64())) for k in ("n_a", "n_b", "n_groups")], pa.array([out["groups_sha256"]], pa.list_(pa.string()))]
                raw = [exchange.pack_keys(pairs), exchange.pack_keys(np.cumsum(ends).astype(np.uint64)), exchange.squeezed(exchange.pack(places.astype(np.uint64)))]
                names = ["block", "n_bytes", "keys", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "ends", "links"]
                yield pa.RecordBatch.from_arrays([*one, *lists, *[pa.array([x], pa.binary()) for x in raw]], names)

    return distinct.mapInArrow(run, PARTS_DDL)


ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("best", pa.list_(pa.struct([("b", pa.int64()), ("n", pa.int64())])))])


def _links(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's links as places of pairs, where each text's end, and the pair keys."""
    places = exchange.unpack(exchange.expanded(row["links"]))
    return places.astype(np.int64), exchange.unpack_keys(row["ends"]).astype(np.int64), exchange.unpack_keys(row["pairs"])


def _ask(blocks: DataFrame, bits: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                places, ends, pairs = _links(row)
                copies = np.repeat(np.array(row["copies"], np.uint64), np.diff(ends, prepend=0))
                counts = exchange.sums(places, copies, len(pairs))
                for bucket, at in exchange.parts(pairs, bits):
                    yield bucket, row["block"], exchange.pack_keys(pairs[at]), exchange.pack(counts[at])

    return blocks.select("block", "copies", "pairs", "ends", "links").mapInArrow(lambda batches: exchange.in_batches(rows(batches), ASKED), "bucket int, block long, pairs binary, counts binary")


def _answer(rows: list[dict]) -> Iterator[tuple]:
    pairs, place, _, ends = exchange.meet([exchange.unpack_keys(r["pairs"]) for r in rows])
    counts = exchange.sums(place, np.concatenate([exchange.unpack(r["counts"]) for r in rows]), len(pairs))
    b = pair_of(pairs)[1]
    order = np.lexsort((counts, b))
    top = order[np.flatnonzero(np.diff(b[order], append=np.uint64(1 << 63)))]
    yield rows[0]["bucket"], None, None, [{"b": int(x), "n": int(n)} for x, n in zip(b[top], counts[top])]
    for i, r in enumerate(rows):
        yield r["bucket"], r["block"], exchange.pack(counts[place[ends[i] : ends[i + 1]]]), None


def _measured(known: DataFrame, best: np.ndarray) -> DataFrame:
    """key, the measures of a text, n_best and count_sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(None)
        for batch in batches:
            for row in batch.to_pylist():
                places, ends, pairs = _links(row)
                counts = np.concatenate([exchange.unpack(x["counts"]) for x in row["answers"] or []] or [np.zeros(0, np.uint64)]).astype(np.int64)
                is_best = counts == best[pair_of(pairs)[1].astype(np.int64)]
                starts = np.concatenate([[0], ends[:-1]])
                sums = [np.concatenate([[0], np.cumsum(x[places])]) for x in (is_best.astype(np.int64), counts)]
                columns = {"key": pa.array(row["keys"], pa.binary()), **{k: pa.array(row[k], pa.int64()) for k in ("n_a", "n_b", "n_groups")}, "n_links": pa.array(row["n_groups"], pa.int64())}
                columns |= {k: pa.array(x[ends] - x[starts]) for k, x in zip(("n_best", "count_sum"), sums)}
                yield pa.RecordBatch.from_pydict(columns | {"groups_sha256": pa.array(row["groups_sha256"], pa.string())})

    return known.mapInArrow(run, "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The measures of every row by its id, and the table of linked id pairs (a, b, n, best: whether it is its B id's highest)."""
    a_path, b_path = a_path or public_path(A_NAME), b_path or public_path(B_NAME)
    slim = pick(docs, doc_id=id_col, text=F.col(text_col).cast("string"))
    distinct = slim.filter(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    blocks = stage(_aligned(distinct, a_path, b_path), "alignment-blocks")
    bits = exchange.bucket_bits(blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    answers = stage(exchange.answered(_ask(blocks, bits), _answer, ANSWER, "bucket int, block long, counts binary, best array<struct<b:long,n:long>>"), "alignment-counts")
    # one row for each id of B: the vocabulary bounds them
    rows = answers.filter(F.col("block").isNull()).select(F.inline("best")).groupBy("b").agg(F.max("n").alias("n")).collect()
    best = np.zeros(1 + max((r.b for r in rows), default=0), np.int64)
    for r in rows:
        best[r.b] = r.n
    known = blocks.join(exchange.by_block(answers, "counts", name="answers"), "block", "left")
    measured = _measured(known, best)
    keyed = slim.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}
    out = keyed.join(measured, "key", "left").select("doc_id", *zero.values(), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return out, _pairs(known, best)


def _pairs(known: DataFrame, best: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = exchange.unpack_keys(row["pairs"])
                a, b = (x.astype(np.int64) for x in pair_of(keys))
                counts = np.concatenate([exchange.unpack(x["counts"]) for x in row["answers"] or []] or [np.zeros(0, np.uint64)]).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "n": pa.array(counts), "best": pa.array(counts == best[b])})

    return known.mapInArrow(run, "a long, b long, n long, best boolean").distinct()


def op11_aligned_vocabularies(spark, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
