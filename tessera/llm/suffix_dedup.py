"""Repeated byte strings across documents, by distributed prefix doubling over suffix ranks.

A byte goes if it is covered by a string of `span` = 2h bytes that also starts in a document with a smaller id. Ranks
of suffixes are hash names of their prefixes. Doubling needs only the lengths h and 2h here, since 2h is the
threshold; and it needs them only for suffixes that are still tied, so ties are first looked for among few suffixes:

1.  Of each window of 2h bytes, the suffix with the least rank of length h is its anchor: equal windows have equal
    anchors. Consecutive windows with one anchor form a unit, and anchors are sampled at about one byte in 13.
    Spark sorts the (rank, document) pairs of the anchors; ranks that one document alone holds are unique and
    end there. A rank that a slice of documents holds more than once is known to be tied and its rows skip the sort,
    but for one; so a passage that stands in very many documents sends few rows to its place in the sort.
2.  Tied anchors get the rank of their unit's whole text. Where that is tied, all windows of the larger documents are
    repeated at once; partial minima make large groups small before they move.
3.  Anchors that stay tied with differing texts around them are re-ranked at twice the length: their windows get the
    pair (rank h at the start, rank h at the offset h), and a window whose pair has a smaller document is repeated.
    Equal windows have equal anchors, so this is done anchor by anchor, sorted by Spark; the windows of anchors with
    very many texts are ranked by a shuffle of their own.

Every step is exact but for collisions of 64-bit (1, only extra work), 128-bit (2, anchor and unit) and 128-bit (3)
names. Texts move once each for steps 2 and 3 and once for the result.

Defined results: a null text is empty; a null doc_id counts as greater than any other and is never a smaller one;
rows with equal ids do not repeat each other; texts of fewer than `span` bytes keep all; matches never cross documents;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_slices, pick
from tessera.runtime import stage, unstage

SPAN = 50
PIECE = 1 << 20
NOBODY = 2**63 - 1
#: Most texts around one anchor that are ranked inside a task; anchors with more go through a shuffle.
MOST_TEXTS = 4096
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64


class Ranks:
    """Hash names of substrings by prefix sums: of any substring in constant time, whole arrays at once."""

    def __init__(self, span: int):
        self.h = span // 2
        most = PIECE + 4 * span
        inverse = pow(BASE, -1, 2**64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, inverse, np.uint64)]), dtype=np.uint64)
        self.table = np.random.default_rng(20).integers(1, 2**64 - 1, 256, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.down[: len(data)], out=out[1:])
        return out

    def name(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.up[start])

    def names(self, sums: np.ndarray) -> np.ndarray:
        """Names of length h at every position that has as many bytes."""
        n = len(sums) - self.h
        return mixed((sums[self.h :] - sums[:n]) * self.up[:n]) if n > 0 else np.zeros(0, np.uint64)


@lru_cache(maxsize=2)
def ranks_for(span: int) -> Ranks:
    return Ranks(span)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1])
    return out


def pieces_of(text: bytes, span: int) -> Iterator[tuple[int, bytes]]:
    """Offsets and parts of a text that hold each window once."""
    for at in range(0, max(0, len(text) - span + 1), PIECE):
        yield at, text[at : at + PIECE + span - 1]


def units_of(parts: list[bytes], ranks: Ranks, span: int) -> tuple[np.ndarray, ...]:
    """part, start, windows, anchor and name of every unit of the parts; their joined bytes and prefix sums.

    start is in the joined bytes; a unit's windows start there and at the following places.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sums = ranks.sums(data)
    h = ranks.h
    lengths = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), data, sums
    least = least_in_windows(ranks.names(sums), span - h + 1)
    fine = np.zeros(len(data) + 1, np.int8)
    long = lengths >= span
    np.add.at(fine, starts[long], 1)
    np.add.at(fine, ends[long] - span + 1, -1)
    fine = np.cumsum(fine[: len(least)], dtype=np.int8).astype(bool)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (fine[1:] != fine[:-1])
    new[starts[long]] = True  # a text may follow another of exactly `span` bytes
    at = np.nonzero(new)[0]
    run = np.diff(np.concatenate([at, [len(least)]]))
    at, run = at[fine[at]], run[fine[at]]
    # periodic text has long runs of one anchor: they are cut
    most = span - h + 1
    times = -(-run // most)
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    begin = np.repeat(at, times) + inner * most
    windows = np.minimum(np.repeat(at + run, times) - begin, most)
    return np.searchsorted(ends, begin, side="right"), begin, windows, least[begin], ranks.name(sums, begin, begin + windows + span - 1), data, sums


def _joined(texts: list[bytes], span: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about a piece's bytes: of each part its text, its offset and its bytes."""
    who, offsets, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at, part in pieces_of(text, span):
            if size and size + len(part) > PIECE:
                yield who, offsets, parts
                who, offsets, parts, size = [], [], [], 0
            who.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield who, offsets, parts


def _bytes_of(part: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in part.column("text").to_pylist()]


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of one row for each distinct combination."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order[new]


def tied_anchors(slim: DataFrame, span: int) -> DataFrame:
    """doc and anchors (packed, sorted): the anchors that a document shares with another."""
    #: k: where a row goes; a: 0 for a rank to be sorted, 1 for one of a slice's known ties, else a known tied anchor

    def emit(part: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = part.column("doc").to_numpy()
        ranks = ranks_for(span)
        docs, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for who, _, parts in _joined(_bytes_of(part), span):
            owner, _, _, anchor, _, _, _ = units_of(parts, ranks, span)
            docs.append(ids[np.array(who)[owner]])
            anchors.append(np.maximum(anchor, np.uint64(2)))
        doc, anchor = np.concatenate(docs), np.concatenate(anchors)
        keep = _distinct(anchor, doc)
        doc, anchor = doc[keep], anchor[keep]
        if not len(doc):
            return None
        first = np.ones(len(anchor), bool)
        first[1:] = anchor[1:] != anchor[:-1]
        size = np.diff(np.concatenate([np.nonzero(first)[0], [len(anchor)]]))
        known = np.repeat(size > 1, size)
        single = ~known
        k = [anchor[single], anchor[first & known], mixed(doc[known].view(np.uint64) + np.arange(known.sum(), dtype=np.uint64))]
        a = [np.zeros(single.sum(), np.uint64), np.ones((first & known).sum(), np.uint64), anchor[known]]
        d = [doc[single], doc[first & known], doc[known]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(k).view(np.int64)), pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(d))], ["k", "a", "doc"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rank at the end of the last batch, whether it is known to be tied, and its one document while it isn't
        rank, tied, waiting = None, False, []
        for batch in batches:
            k, a, doc = (batch.column(x).to_numpy() for x in ("k", "a", "doc"))
            ready = (a != 0) & (a != 1)
            out_doc, out_anchor = [doc[ready]], [a[ready]]
            k, a, doc = k[~ready], a[~ready], doc[~ready]
            if len(k):
                new = np.ones(len(k), bool)
                new[1:] = k[1:] != k[:-1]
                at = np.nonzero(new)[0]
                end = np.concatenate([at[1:], [len(k)]])
                ties = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) | (np.maximum.reduceat(a, at) == 1)
                if rank is not None and k[0] == rank:
                    ties[0] |= tied or bool(waiting and (doc[: end[0]] != waiting[0]).any())
                    if ties[0] and waiting:
                        out_doc.append(np.array(waiting))
                        out_anchor.append(np.array([rank]))
                        waiting = []
                else:
                    waiting = []
                emitted = np.repeat(ties, end - at) & (a == 0)
                out_doc.append(doc[emitted])
                out_anchor.append(k[emitted])
                rank, tied = k[-1], bool(ties[-1])
                last = doc[at[-1] :][a[at[-1] :] == 0]
                if tied:
                    waiting = []
                elif len(last) and not (len(at) == 1 and waiting):
                    waiting = [last[0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_anchor).astype(np.int64))], ["doc", "anchor"])

    rows = map_slices(slim, "text", emit, "k long, a long, doc long")
    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = rows.repartition(n, "k").sortWithinPartitions("k").mapInArrow(rerank, "doc long, anchor long")
    return ranked.groupBy("doc").agg(F.collect_list("anchor").alias("anchors"))


def _chosen(part: pa.RecordBatch, wanted: list[np.ndarray], by: str, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """text, begin, windows, anchor and name of the units whose anchor (or name) is wanted of their text, and the bytes that begin counts in."""
    ranks = ranks_for(span)
    for who, _, parts in _joined(_bytes_of(part), span):
        owner, begin, windows, anchor, name, data, _ = units_of(parts, ranks, span)
        anchor, name = np.maximum(anchor, np.uint64(2)).view(np.int64), name.view(np.int64)
        key = anchor if by == "anchor" else name
        of = np.array(who)[owner]
        keep = np.zeros(len(of), bool)
        cuts = np.nonzero(np.diff(of))[0] + 1
        for rows in np.split(np.arange(len(of)), cuts) if len(of) else []:
            w = wanted[of[rows[0]]]
            found = np.minimum(np.searchsorted(w, key[rows]), len(w) - 1)
            keep[rows] = w[found] == key[rows]
        at = np.nonzero(keep)[0]
        at = at[_distinct(of[at], anchor[at], name[at])]
        yield of[at], begin[at], windows[at], anchor[at], name[at], data


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.sort(np.asarray(column[i].values.to_numpy(zero_copy_only=False))) for i in range(len(column))]


def tied_units(slim: DataFrame, tied: DataFrame, span: int) -> DataFrame:
    """doc, anchor and name of every distinct unit whose anchor is tied."""

    def emit(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part.column("doc").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for of, _, _, anchor, name, _ in _chosen(part, _lists(part.column("anchors")), "anchor", span):
            for column, values in zip(out, (ids[of], anchor, name)):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], ["doc", "anchor", "name"])

    met = slim.join(tied.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc")).select("doc", "text", "anchors")
    return map_slices(met, "text", emit, "doc long, anchor long, name long")


def unit_bytes(slim: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """least, anchor, name and bytes of the wanted units (least, names), read from the texts of their least documents."""

    def emit(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part.column("doc").to_numpy()
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []]
        for of, begin, windows, anchor, name, data in _chosen(part, _lists(part.column("names")), "name", span):
            raw = data.tobytes()
            for column, values in zip(out, (ids[of], anchor, name)):
                column.append(values)
            out[3] += [raw[s : s + w + span - 1] for s, w in zip(begin.tolist(), windows.tolist())]
        return pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in out[:3]], pa.array(out[3], pa.binary())], ["least", "anchor", "name", "bytes"])

    met = slim.join(wanted, F.col("doc") == F.col("least")).select("doc", "text", "names")
    return map_slices(met, "text", emit, "least long, anchor long, name long, bytes binary")


def _window_ranks(texts: list[bytes], span: int) -> tuple[np.ndarray, ...]:
    """x, y (the rank pair at offset h), the row and the place in it of every window of some units' bytes."""
    ranks = ranks_for(span)
    h = ranks.h
    counts = np.array([len(t) - span + 1 for t in texts], np.int64)
    starts = np.cumsum([0, *[len(t) for t in texts]])[:-1]
    step = PIECE // (4 * span)
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for at in range(0, len(texts), step):
        names = ranks.names(ranks.sums(np.frombuffer(b"".join(texts[at : at + step]), np.uint8)))
        n = counts[at : at + step]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(starts[at : at + step] - starts[at], n) + inner
        for column, values in zip(out, (names[place], names[place + span - h], np.repeat(np.arange(at, at + len(n)), n), inner)):
            column.append(values)
    x, y, row, inner = (np.concatenate(o) for o in out)
    return x, y, row, inner


def _rerank_groups(units: DataFrame, span: int) -> DataFrame:
    """doc, name and mask from the units of anchors with a bounded number of texts: sorted by anchor, ranked in the task that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ranked(rows: pa.Table) -> pa.RecordBatch:
            anchor, name, least = (rows.column(c).to_numpy() for c in ("anchor", "name", "least"))
            x, y, row, inner = _window_ranks(rows.column("bytes").to_pylist(), span)
            order = np.lexsort((least[row], y, x, anchor[row]))
            x, y, row, inner = x[order], y[order], row[order], inner[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (anchor[row[1:]] != anchor[row[:-1]])
            first = least[row[new]][np.cumsum(new) - 1]
            hit = first < least[row]
            masks = np.zeros(rows.num_rows, np.int64)
            np.bitwise_or.at(masks, row[hit], np.int64(1) << inner[hit])
            good = masks != 0
            return pa.RecordBatch.from_arrays([pa.array(least[good]), pa.array(name[good]), pa.array(masks[good])], ["doc", "name", "mask"])

        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            if not len(anchor):
                continue
            cut = int(np.nonzero(anchor == anchor[-1])[0][0])
            # rows are sorted: all before the last anchor's are whole, unless the batch has that anchor alone
            if cut or (held and held[-1].column("anchor")[0].as_py() != anchor[0]):
                done = pa.Table.from_batches([*held, batch.slice(0, cut)])
                if done.num_rows:
                    yield ranked(done)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield ranked(pa.Table.from_batches(held))

    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc long, name long, mask long")


def _rerank_wide(units: DataFrame, span: int) -> DataFrame:
    """The same for anchors with more texts than a task should hold: their windows are ranked by a shuffle."""

    def emit(part: pa.RecordBatch) -> pa.RecordBatch:
        x, y, row, inner = _window_ranks(part.column("bytes").to_pylist(), span)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), *[pa.array(part.column(c).to_numpy()[row]) for c in ("least", "name")], pa.array(inner.astype(np.int32))], ["x", "y", "least", "name", "at"])

    windows = stage(map_slices(units, "bytes", emit, "x long, y long, least long, name long, at int"), "dedup-windows")
    ranks = windows.groupBy("x", "y").agg(F.min("least").alias("a"), F.max("least").alias("z")).filter("a < z").select(F.col("x").alias("_x"), F.col("y").alias("_y"), "a")
    hits = windows.join(stage(ranks, "dedup-ranks"), (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("a") < F.col("least")))
    return hits.groupBy("least", "name").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask")).select(F.col("least").alias("doc"), "name", "mask")


def repeated_windows(slim: DataFrame, units: DataFrame, span: int, most: int = MOST_TEXTS) -> DataFrame:
    """doc, marks: (name, mask) pairs of each document's units; a bit for each window that is repeated, -1 for all."""
    first = stage(units.groupBy("anchor", "name").agg(F.min("doc").alias("least"), F.max("doc").alias("greatest")), "dedup-first")
    sides = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("a"), F.max("least").alias("z")).filter("n > 1 and a < z").select(F.col("anchor").alias("_anchor"), "n")
    sides = stage(sides, "dedup-open")
    open_ = first.join(sides, F.col("anchor") == F.col("_anchor")).groupBy("least").agg(F.collect_list("name").alias("names"))
    wanted = stage(open_, "dedup-wanted")
    bytes_ = stage(unit_bytes(slim, wanted, span), "dedup-bytes")
    # a unit that shares its name, but not its anchor, with a wanted one comes along and goes here
    texts = bytes_.join(sides, F.col("anchor") == F.col("_anchor")).drop("_anchor")
    partly = stage(_rerank_groups(texts.filter(F.col("n") <= most).drop("n"), span).unionByName(_rerank_wide(texts.filter(F.col("n") > most).drop("n"), span)), "dedup-partly")
    for done in (wanted, bytes_, sides):
        unstage(done)
    wholly = units.join(first.filter("least < greatest").select(F.col("anchor").alias("_anchor"), F.col("name").alias("_name"), "least"), (F.col("anchor") == F.col("_anchor")) & (F.col("name") == F.col("_name")) & (F.col("least") < F.col("doc")))
    both = wholly.select("doc", "name", F.lit(-1).cast("long").alias("mask")).unionByName(partly)
    return both.groupBy("doc").agg(F.collect_list(F.struct("name", "mask")).alias("marks"))


def remove_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with_kept adds the kept bytes."""
    if span % 2 or not 8 <= span <= 120:
        raise ValueError("span must be even, from 8 to 120")
    raw = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    slim = pick(docs, doc_id=id_col, doc=F.coalesce(docs[id_col].cast("long"), F.lit(NOBODY)), text=raw)
    long = slim.filter(F.length("text") >= span).select("doc", "text")
    tied = stage(tied_anchors(long, span), "dedup-tied")
    units = stage(tied_units(long, tied, span), "dedup-units")
    unstage(tied)
    marks = stage(repeated_windows(long, units, span), "dedup-documents")
    unstage(units)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, marked = _bytes_of(part), part.column("marks")
        ranks = ranks_for(span)
        edges = {i: np.zeros(len(t) + 1, np.int32) for i, t in enumerate(texts) if marked[i].is_valid}
        some = sorted(edges)
        names: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in some:
            pairs = marked[i].values
            name, mask = (np.asarray(pairs.field(c).to_numpy(zero_copy_only=False)) for c in ("name", "mask"))
            order = np.argsort(name, kind="stable")
            names[i] = name[order], mask[order]
        for who, offsets, parts in _joined([texts[i] for i in some], span):
            owner, begin, windows, _, name, _, _ = units_of(parts, ranks, span)
            lengths = np.array([len(p) for p in parts])
            base = np.cumsum(lengths) - lengths
            cuts = np.nonzero(np.diff(owner))[0] + 1
            for rows in np.split(np.arange(len(owner)), cuts) if len(owner) else []:
                p = owner[rows[0]]
                i = some[who[p]]
                known, masks = names[i]
                at = np.minimum(np.searchsorted(known, name[rows].view(np.int64)), len(known) - 1)
                hit = known[at] == name[rows].view(np.int64)
                rows, mask = rows[hit], masks[at[hit]]
                place = begin[rows] - base[p] + offsets[p]
                edge = edges[i]
                whole = mask == -1
                np.add.at(edge, place[whole], 1)
                np.add.at(edge, place[whole] + windows[rows][whole] + span - 1, -1)
                for s, m in zip(place[~whole].tolist(), mask[~whole].tolist()):
                    for bit in range(m.bit_length()):
                        if m >> bit & 1:
                            edge[s + bit] += 1
                            edge[s + bit + span] -= 1
        out: list[list] = [[], [], [], [], []]
        for i, text in enumerate(texts):
            kept, removed, spans = text, 0, 0
            if i in edges:
                gone = np.cumsum(edges[i][:-1]) > 0
                removed = int(gone.sum())
                if removed:
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for column, value in zip(out, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                column.append(value)
        arrays = [part.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3])]
        names_ = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_kept:
            arrays.append(pa.array(out[4], pa.binary()))
            names_.append("kept")
        return pa.RecordBatch.from_arrays(arrays, names_)

    met = slim.join(marks.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc"), "left").select("doc_id", "text", "marks")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_slices(met, "text", cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)


def op10_prefix_doubling(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
