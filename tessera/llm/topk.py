"""Exact top-k by inner product with ball trees.

Every task packs its vectors into shards of bounded rows, sorted into the leaves of a ball tree that is kept as flat
arrays (centre, radius and rows of each node). The search takes query blocks, not single queries: a node's bound for a
query is the product with the centre plus the query's norm times the radius; nodes are visited from the greatest bound
on, children of a node only while its bound reaches the query's current kth score, and leaves are scored with one
matrix product.

Queries go through the shards in waves: their own shard first, then one other, two, four and so on, from the shard
with the greatest bound for the block on. After each wave the hits of its shards are merged, and the kth scores, which
only rise, go with the block into the next one. A block isn't sent to shards whose bound none of its queries reaches. Sorted
by shard, a shard is loaded once for a slice of blocks, which pass by one at a time.

Components become floor(64 x). Scores are products of whole numbers: by floating-point matrix products while no score
can reach 2 ** 53, else by Python's integers in the leaves that the bounds (which allow for rounding) leave over.

Defined results: vectors that are null or hold a null or non-finite component take no part, as rows or as queries;
vectors of different lengths don't meet, empty ones have scores of 0; a row is never its own candidate, but a
repeated row is the other's; ties go to the smaller vec_id, a null one last; a row without a vec_id is no query; scores beyond the range of long
are its ends and tie there; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pick
from tessera.runtime import stage, unstage

K = 20
SCALE = 64
EVERY = 20
SHARD_ROWS = 1 << 15
LEAF_ROWS = 128
BLOCK = 512
#: Most blocks that meet a shard in one task.
SLICE = 256
LEAST, NO_ID = -(2**63), 2**63 - 1
EXACT = 2.0**53
PACKED = "shard long, dim int, n int, ids binary, vectors binary, uids binary, nodes binary, centres binary, queries binary, at binary, found binary, scores binary"
BLOCKS = "block long, home long, dim int, quids binary, qids binary, qvectors binary, centre binary, reach double, norm double, at binary, found binary, scores binary, least double"


class BallTree:
    """A binary tree of balls over integer vectors (held as doubles)."""

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray, centres: np.ndarray):
        #: nodes: start, end, left, right (-1 for leaves) and radius of each node
        self.vectors, self.nodes, self.centres = vectors, nodes, centres

    @classmethod
    def build(cls, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[BallTree, np.ndarray]:
        """The tree, and the order that its rows have in it."""
        order = np.arange(len(vectors))
        nodes: list[list[float]] = []
        centres: list[np.ndarray] = []
        todo = [(0, len(vectors), -1, 2)]
        while todo:
            start, end, parent, side = todo.pop()
            rows = vectors[order[start:end]]
            with np.errstate(over="ignore", invalid="ignore"):
                centre = rows.mean(axis=0)
                apart = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            at = len(nodes)
            nodes.append([start, end, -1, -1, float(apart.max()) if len(rows) else 0.0])
            centres.append(centre)
            if parent >= 0:
                nodes[parent][side] = at
            if end - start > leaf:
                # halves by the direction between two far rows
                with np.errstate(over="ignore", invalid="ignore"):
                    a = rows[np.nan_to_num(apart).argmax()]
                    b = rows[np.nan_to_num(((rows - a) ** 2).sum(axis=1)).argmax()]
                    along = np.nan_to_num(rows @ (b - a))
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(along, middle)]
                todo += [(start + middle, end, at, 3), (start, start + middle, at, 2)]
        return cls(vectors[order], np.array(nodes), np.array(centres).reshape(len(nodes), -1)), order

    def search(self, queries: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, full: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of each query's k best rows, sorted; queries that are full need floor or more. own: the row to leave out, or -1."""
        n = len(queries)
        scores_, ids_, have = np.full((n, k), LEAST), np.full((n, k), NO_ID), np.zeros(n, np.int64)
        kth, full = np.where(full, floor, LEAST), full.copy()
        bounds = upper_bounds(queries, self.centres, self.nodes[:, 4])
        product = exact_products(queries, self.vectors)
        heap: list[tuple[float, int, np.ndarray]] = [(-np.inf, 0, np.arange(n))]
        while heap:
            _, node, some = heapq.heappop(heap)  # a node is in the heap once at most, so arrays are never compared
            some = some[~full[some] | (bounds[some, node] >= kth[some])]
            if not len(some):
                continue
            start, end, left, right = (int(x) for x in self.nodes[node, :4])
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-float(bounds[some, child].max()), child, some))
                continue
            scores = product(some, start, end)
            good = ~full[some][:, None] | (scores >= kth[some][:, None])
            inside = (own[some] >= start) & (own[some] < end)
            good[np.nonzero(inside)[0], own[some][inside] - start] = False
            hit = good.any(axis=1)
            some, scores, good = some[hit], scores[hit], good[hit]
            if not len(some):
                continue
            all_scores = np.concatenate([scores_[some], scores], axis=1)
            all_ids = np.concatenate([ids_[some], np.broadcast_to(ids[start:end], scores.shape)], axis=1)
            bad = np.concatenate([np.arange(k)[None, :] >= have[some][:, None], ~good], axis=1)
            take = np.lexsort((all_ids, ~all_scores, bad), axis=1)[:, :k]
            scores_[some], ids_[some] = np.take_along_axis(all_scores, take, 1), np.take_along_axis(all_ids, take, 1)
            have[some] = np.minimum((~bad).sum(axis=1), k)
            whole = some[have[some] == k]
            kth[whole] = np.where(full[whole], np.maximum(kth[whole], scores_[whole, -1]), scores_[whole, -1])
            full[whole] = True
        there = np.arange(k)[None, :] < have[:, None]
        return np.nonzero(there)[0], ids_[there], scores_[there]


def norms_of(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((rows**2).sum(axis=1))


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For every query and ball, at least as much as any product with a vector in the ball, in spite of rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        reach = norms_of(queries)[:, None]
        out = queries @ centres.T + reach * radii[None, :]
        out += 1 + 1e-9 * reach * (norms_of(centres) + radii)[None, :]
    return np.where(np.isfinite(out), out, np.inf)


def exact_products(queries: np.ndarray, vectors: np.ndarray):
    """A function for the whole-number products of some queries with a range of vectors, as longs (kept to their range)."""
    with np.errstate(over="ignore"):
        safe = queries.shape[1] * np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) < EXACT
    if safe:
        return lambda some, start, end: (queries[some] @ vectors[start:end].T).astype(np.int64)

    def slow(some: np.ndarray, start: int, end: int) -> np.ndarray:
        left, right = ([[int(x) for x in row] for row in rows.tolist()] for rows in (queries[some], vectors[start:end]))
        return np.array([[min(max(sum(x * y for x, y in zip(a, b)), LEAST), NO_ID) for b in right] for a in left], np.int64)

    return slow


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) as doubles, which from 2 ** 53 on are whole numbers as they are."""
    most = float(np.finfo(float).max)

    def one(x: Column) -> Column:
        y = F.greatest(F.least(F.lit(float(scale)) * x, F.lit(most)), F.lit(-most))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def best_of(at: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each query number."""
    order = np.lexsort((found, ~scores, at))
    at, found, scores = at[order], found[order], scores[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    keep = place < k
    return at[keep], found[keep], scores[keep]


def floors_of(at: np.ndarray, scores: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's kth score (of sorted hits), and whether it has as many."""
    full = np.bincount(at, minlength=n) >= k
    floor = np.full(n, LEAST)
    last = np.searchsorted(at, np.arange(n), side="right") - 1
    floor[full] = scores[last[full]]
    return floor, full


def _least(floor: np.ndarray, full: np.ndarray) -> float:
    """No more than any kth score of the block."""
    return float(np.nextafter(float(floor.min()), -np.inf)) if full.all() else -np.inf


def _row(values: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    names = dict(c.split() for c in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array([values[c].tobytes() if isinstance(values[c], np.ndarray) else values[c]], kinds[kind]) for c, kind in names.items()], list(names))


def pack_shards(vectors: DataFrame, k: int, every: int, rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard (see PACKED), with its own queries already searched in it; vectors: uid, vec_id, q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        counts: dict[int, int] = {}

        def out(dim: int) -> pa.RecordBatch:
            uids, ids, named, flat = (np.concatenate(x) for x in zip(*held.pop(dim)))
            counts.pop(dim)
            tree, order = BallTree.build(flat.reshape(len(ids), dim))
            uids, ids, named = uids[order], ids[order], named[order]
            queries = np.nonzero(named & (ids % every == 0))[0]
            hits: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
            for s in range(0, len(queries), BLOCK):
                part = queries[s : s + BLOCK]
                at, found, scores = tree.search(tree.vectors[part], ids, k, np.full(len(part), LEAST), np.zeros(len(part), bool), part)
                hits.append((at + s, found, scores))
            at, found, scores = (np.concatenate(x) for x in zip(*hits))
            return _row({"shard": int(uids[0]), "dim": dim, "n": len(ids), "ids": ids, "vectors": tree.vectors, "uids": uids, "nodes": tree.nodes, "centres": tree.centres, "queries": queries, "at": at, "found": found, "scores": scores}, PACKED)

        for batch in batches:
            column = batch.column("q")
            lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            uids, named = batch.column("uid").to_numpy(), batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id").fill_null(NO_ID).to_numpy()
            for dim in np.unique(lengths).tolist():
                chosen = np.nonzero(lengths == dim)[0]
                for at in range(0, len(chosen), rows):
                    part = chosen[at : at + rows]
                    values = flat[(starts[part][:, None] + np.arange(dim)[None, :])]
                    held.setdefault(dim, []).append((uids[part].astype(np.int64), ids[part].astype(np.int64), named[part], values.ravel()))
                    counts[dim] = counts.get(dim, 0) + len(part)
                    if counts[dim] >= rows:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return vectors.mapInArrow(run, PACKED)


def _blocks(shards: DataFrame, k: int) -> DataFrame:
    """The shards' queries in blocks (see BLOCKS), with the ball that a block's vectors lie in and their greatest norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                queries, at, found, scores = (_longs(row[c]) for c in ("queries", "at", "found", "scores"))
                vectors = np.frombuffer(row["vectors"]).reshape(row["n"], row["dim"])
                uids, ids = _longs(row["uids"]), _longs(row["ids"])
                for s in range(0, len(queries), BLOCK):
                    p = queries[s : s + BLOCK]
                    mine = (at >= s) & (at < s + BLOCK)
                    with np.errstate(over="ignore", invalid="ignore"):
                        centre = vectors[p].mean(axis=0)
                        reach = float(norms_of(vectors[p] - centre).max())
                    yield _row({"block": int(uids[p[0]]), "home": row["shard"], "dim": row["dim"], "quids": uids[p], "qids": ids[p], "qvectors": vectors[p], "centre": centre, "reach": reach, "norm": float(norms_of(vectors[p]).max()), "at": at[mine] - s, "found": found[mine], "scores": scores[mine], "least": _least(*floors_of(at[mine] - s, scores[mine], len(p), k))}, BLOCKS)

    return shards.filter(F.length("queries") > 0).mapInArrow(run, BLOCKS)


def _visits(blocks: DataFrame, shards: DataFrame) -> DataFrame:
    """block, shard, bound (for all its queries) and wave of every shard that a block may have to visit: 1, 2, 4, ... shards by descending bound."""
    roots = shards.select("shard", "dim", F.expr("substring(centres, 1, dim * 8)").alias("middle"), F.expr("substring(nodes, 33, 8)").alias("radius"))
    met = blocks.select("block", "home", "dim", "centre", "reach", "norm").join(roots, "dim").filter("home <> shard").select("block", "shard", "dim", "centre", "reach", "norm", "middle", "radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            bound = np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                rows = np.nonzero(dims == dim)[0]
                a, b = (np.frombuffer(b"".join(batch.column(c).take(pa.array(rows)).to_pylist())).reshape(len(rows), dim) for c in ("centre", "middle"))
                radius = np.frombuffer(b"".join(batch.column("radius").take(pa.array(rows)).to_pylist()))
                reach, norm = (batch.column(c).to_numpy()[rows] for c in ("reach", "norm"))
                with np.errstate(over="ignore", invalid="ignore"):
                    most = (a * b).sum(axis=1) + reach * norms_of(b) + norm * radius
                    most += 1 + 1e-9 * norm * (norms_of(b) + radius)
                bound[rows] = np.where(np.isfinite(most), most, np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("shard"), pa.array(bound)], ["block", "shard", "bound"])

    bounds = met.mapInArrow(run, "block long, shard long, bound double")
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.col("bound").desc(), "shard"))
    return bounds.withColumn("wave", F.floor(F.log2(rank)).cast("int"))


def _wave(state: DataFrame, visits: DataFrame, shards: DataFrame, slices: int, k: int) -> DataFrame:
    """The blocks with the hits of the visited shards merged in; visits and state are staged."""
    n = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    visits = visits.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)))
    sent = visits.join(state, "block").filter("bound >= least").select("shard", "slice", "block", "dim", "quids", "qvectors", "at", "scores")
    keys = visits.join(state.select("block", "least"), "block").filter("bound >= least").select("shard", "slice").distinct()
    none = F.lit(None).cast("binary")
    heads = shards.join(keys, "shard").select("shard", "slice", F.lit(None).cast("long").alias("block"), "dim", F.col("uids").alias("quids"), F.col("vectors").alias("qvectors"), F.col("ids").alias("at"), none.alias("scores"), "nodes", "centres")
    rows = heads.unionByName(sent.withColumn("nodes", none).withColumn("centres", none))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ids = uids = order = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                dim, quids = row["dim"], _longs(row["quids"])
                vectors = np.frombuffer(row["qvectors"]).reshape(len(quids), dim)
                if row["block"] is None:
                    nodes = np.frombuffer(row["nodes"]).reshape(-1, 5)
                    tree = BallTree(vectors, nodes, np.frombuffer(row["centres"]).reshape(len(nodes), dim))
                    ids = _longs(row["at"])
                    continue
                floor, full = floors_of(_longs(row["at"]), _longs(row["scores"]), len(quids), k)
                # a query's own row lies in its home shard, which it has been in
                at, found, scores = tree.search(vectors, ids, k, floor, full, np.full(len(quids), -1))
                if len(at):
                    yield _row({"block": row["block"], "at": at, "found": found, "scores": scores}, "block long, at binary, found binary, scores binary")

    parts = max(n, 2 * keys.count())
    hits = rows.repartition(parts, "shard", "slice").sortWithinPartitions("shard", "slice", F.col("block").asc_nulls_first()).mapInArrow(search, "block long, at binary, found binary, scores binary")
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    rest = {f.name: f.dataType for f in state.schema if f.name not in ("block", "at", "found", "scores")}
    both = state.select(*names).unionByName(hits.select("block", *[F.lit(None).cast(t).alias(c) for c, t in rest.items()], "at", "found", "scores"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict | None = None

        def done() -> pa.RecordBatch:
            at, found, scores = best_of(*(np.concatenate(whole[c]) for c in ("at", "found", "scores")), k)
            n = len(whole["quids"]) // 8
            return _row(whole | {"at": at, "found": found, "scores": scores, "least": _least(*floors_of(at, scores, n, k))}, BLOCKS)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lists = {c: [_longs(row[c])] for c in ("at", "found", "scores")}
                if row["quids"] is None:
                    for c, x in lists.items():
                        whole[c] += x
                    continue
                if whole is not None:
                    yield done()
                whole = row | lists
        if whole is not None:
            yield done()

    return both.repartition(n, "block").sortWithinPartitions("block", F.col("quids").isNull()).mapInArrow(merge, BLOCKS)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k best rows; queries are the rows with an id divisible by `every`."""
    slim = pick(vectors, vec_id=F.col(id_col).cast("long"), v=vectors[vector_col].cast("array<double>"))
    sound = slim.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sound = sound.select("vec_id", quantise(F.col("v")).alias("q"), F.monotonically_increasing_id().alias("uid"))
    shards = stage(pack_shards(sound, k, every, shard_rows), "shards")
    state = stage(_blocks(shards, k), "blocks")
    visits = stage(_visits(state, shards), "visits")
    last, many = visits.agg(F.max("wave")).first()[0], state.count()
    for wave in range(0 if last is None else last + 1):
        before, state = state, stage(_wave(state, visits.filter(F.col("wave") == wave), shards, -(-many // SLICE), k), "blocks")
        unstage(before)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["qids", "at", "found", "scores"]).to_pylist():
                at, found, scores = (_longs(row[c]) for c in ("at", "found", "scores"))
                rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
                yield pa.RecordBatch.from_arrays([pa.array(_longs(row["qids"])[at]), pa.array(rank.astype(np.int32)), pa.array(found, mask=found == NO_ID), pa.array(scores)], ["query_id", "rank", "vec_id", "score"])

    return state.select("qids", "at", "found", "scores").mapInArrow(rows, "query_id long, rank int, vec_id long, score long")


def op3_ball_tree_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
