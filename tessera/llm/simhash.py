"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed per document from word shingles; equal ones are merged first (with partial sums), so copies
cost nothing further. The distinct fingerprints are range-sorted by the population counts of their four 16-bit parts
and packed into tiles of bounded size, each with the least and greatest count of every part. As the counts of two
words differ by no more than the words do in bits, the sums of the gaps between two tiles' ranges bound the distance
of all their pairs from below: tile pairs beyond the radius are skipped, the others are compared with exclusive-or
and bit counts in numpy, sub-tile by sub-tile under the same bound. A compared pair of tiles emits a spanning forest
of its links, never all pairs; connected components then come from alternating large-star and small-star rounds over
those links, each round staged.

All pairs within the radius are found; the work is quadratic in the distinct fingerprints with a small constant.

Defined results: null or wordless texts have fingerprint 0 and are linked like any other; texts are read whole;
repeated ids keep a row each; a null doc_id takes part but is never the name of a component unless nothing else is;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_slices, pick
from tessera.runtime import stage, unstage

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 1 << 14
SUB = 256
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
BITS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The XXH64 values of the lower-cased (A-Z) text's word shingles, repeats included; fewer words are one shingle."""
    words = WORDS.findall(text.lower())
    if not words:
        return np.zeros(0, "<u8")
    if len(words) < size:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
        n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in shingles), "<u8", n)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is set if it is set in over half the shingles' hashes."""
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    n = len(hashes)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << BITS)[2 * votes > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", keep: dict | None = None, text_as: str | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row; `keep` adds columns of docs, text_as the text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x or b"", size) for x in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
        names = [x for x in part.schema.names if x != "text"]
        whole = [part.column("text")] if text_as else []
        return pa.RecordBatch.from_arrays([*[part.column(x) for x in names], *whole, pa.array(fps.view(np.int64))], [*names, *[text_as] * len(whole), "fp"])

    slim = pick(docs, doc_id=id_col, text=F.col(text_col).cast("string"), **(keep or {}))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    fields += f", `{text_as}` string" if text_as else ""
    return map_slices(slim, "text", run, f"{fields}, fp long")


def _parts(fps: np.ndarray) -> np.ndarray:
    """The population counts of the four 16-bit parts, one row for each fingerprint."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _tiles(fps: DataFrame, tile: int) -> DataFrame:
    """tile, low, high (least and greatest counts) and fps (packed words), from distinct fps."""
    counts = [F.bit_count(F.shiftright("fp", 16 * i).bitwiseAND(0xFFFF)) for i in range(4)]
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = fps.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(counts)]).repartitionByRange(n, "c0", "c1", "c2", "c3", "fp").sortWithinPartitions("c0", "c1", "c2", "c3", "fp").select("fp", F.spark_partition_id().cast("long").alias("part"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows, at, part = 0, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal at
            words = np.concatenate(held)
            counts = _parts(words)
            row = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + at]), pa.array([counts.min(axis=0).tolist()], pa.list_(pa.int32())), pa.array([counts.max(axis=0).tolist()], pa.list_(pa.int32())), pa.array([words.tobytes()], pa.binary())],
                ["tile", "low", "high", "fps"],
            )
            at += 1
            return row

        for batch in batches:
            words = batch.column("fp").to_numpy().astype("<i8")
            part = batch.column("part")[0].as_py()
            while len(words):
                take = words[: tile - rows]
                held.append(take)
                rows += len(take)
                words = words[len(take) :]
                if rows == tile:
                    yield out()
                    held, rows = [], 0
        if rows:
            yield out()

    return ranged.mapInArrow(pack, "tile long, low array<int>, high array<int>, fps binary")


def _gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Least distance of boxes of counts: the sum of the gaps between their ranges."""
    return np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)).sum(axis=-1)


def _forest(links: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """Those of the links that join two trees of a growing forest."""
    parent = list(range(n))
    kept = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((i, j))
    return kept


def compare(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, sub: int = SUB) -> list[tuple[int, int]]:
    """A spanning forest of the links of two tiles (or within one, if b is None), as pairs of fingerprints."""
    both = a if b is None else np.concatenate([a, b])
    counts = _parts(both)
    starts = list(range(0, len(a), sub)) + ([] if b is None else list(range(len(a), len(both), sub)))
    ends = [min(s + sub, len(a) if s < len(a) else len(both)) for s in starts]
    low = np.array([counts[s:e].min(axis=0) for s, e in zip(starts, ends)])
    high = np.array([counts[s:e].max(axis=0) for s, e in zip(starts, ends)])
    first = range(len(starts)) if b is None else range(-(-len(a) // sub))

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in first:
            others = np.arange(i, len(starts)) if b is None else np.arange(len(first), len(starts))
            near = others[_gap(low[i], high[i], low[others], high[others]) <= radius]
            for j in near:
                x, y = both[starts[i] : ends[i]], both[starts[j] : ends[j]]
                r, c = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                r, c = r + starts[i], c + starts[j]
                if i == j:
                    r, c = r[r < c], c[r < c]
                if len(r):
                    yield r, c

    return [(int(both[i]), int(both[j])) for i, j in _forest(links(), len(both))]


def _tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """a, b: the pairs of tiles (a <= b) whose boxes of counts come within the radius, each once.

    A band join over the first two counts: one side goes to all values of its ranges widened by the radius, the other to those of its own,
    and a pair counts at the first values that it has in common.
    """

    def side(x: str, wider: int) -> DataFrame:
        df = tiles.select(F.col("tile").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))
        for k in (0, 1):
            df = df.withColumn(f"k{k}", F.explode(F.sequence(F.col(f"low_{x}")[k] - wider, F.col(f"high_{x}")[k] + wider)))
        return df

    first = [F.col(f"k{k}") == F.greatest(F.col("low_a")[k] - radius, F.col("low_b")[k]) for k in (0, 1)]
    gaps = [F.greatest(F.lit(0), F.col("low_a")[k] - F.col("high_b")[k], F.col("low_b")[k] - F.col("high_a")[k]) for k in range(4)]
    met = side("a", radius).join(side("b", 0), ["k0", "k1"])
    return met.filter((F.col("a") <= F.col("b")) & first[0] & first[1] & (sum(gaps[1:], gaps[0]) <= radius)).select("a", "b")


def _links(tiles: DataFrame, radius: int) -> DataFrame:
    """a, b: fingerprints that are linked, enough of them to span each component.

    Sorted by the pairs' first tile, which a task holds while the second ones pass by.
    """
    spark = tiles.sparkSession
    pairs = stage(_tile_pairs(tiles, radius), "tile-pairs")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // 64))
    seconds = pairs.join(tiles.select(F.col("tile").alias("b"), "fps"), "b").select("a", "b", "fps").filter("a < b")
    rows = tiles.select(F.col("tile").alias("a"), F.lit(-1).cast("long").alias("b"), "fps").unionByName(seconds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            for b, fps in zip(batch.column("b").to_pylist(), batch.column("fps")):
                words = np.frombuffer(fps.as_py(), "<u8")
                first = words if b < 0 else first
                found = compare(first, None if b < 0 else words, radius)
                if found:
                    out = np.array(found, np.uint64).view(np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return rows.repartition(n, "a").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each node of links (a, b) can reach, by alternating large-star and small-star rounds.

    Every round takes neighbours' minima with partial aggregation and joins them back; both sides are staged, so a hub
    with very many links is split by the engine's skew join. Rounds end when the links are all node-to-root stars.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        size, check = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if (size, check) == before or size == 0:
            break
        before = (size, check)
        for large in (True, False):
            sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
            least = stage(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
            moved = sides.join(least, "u")
            if large:  # greater neighbours are hung on the least one around
                moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:  # all smaller neighbours, and the node itself, are hung on the least
                moved = moved.select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            new = stage(moved.filter("u <> v").distinct(), "links")
            unstage(edges)
            unstage(least)
            edges = new
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def links_within(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links between distinct fingerprints (fp), enough of them to span each component; staged."""
    tiles = stage(_tiles(fps.select("fp"), tile), "tiles")
    links = stage(_links(tiles, radius), "tile-links")
    unstage(tiles)
    return links


def groups_of(rows: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fp, group (a fingerprint that names the component) and component_id (its least doc_id), for staged rows of (doc_id, fp)."""
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints-distinct")
    roots = stage(components(links_within(distinct, radius, tile)), "roots")
    linked = stage(distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least"), "linked")
    named = linked.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("name"))
    of_linked = stage(linked.join(stage(named, "names"), F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "name"), "linked-names")
    everywhere = distinct.join(of_linked, F.col("fp") == F.col("_fp"), "left")
    group = F.coalesce("root", "fp")
    return stage(everywhere.select("fp", group.alias("group"), F.when(F.col("root").isNotNull(), F.col("name")).otherwise(F.col("least")).alias("component_id")), "components")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, keep: dict | None = None, **columns) -> DataFrame:
    """doc_id, fp, group and component_id (the least doc_id that links reach) of every row; `keep` adds columns of docs."""
    rows = stage(fingerprints(docs, size, keep=keep, **columns), "fingerprints")
    named = groups_of(rows.select("doc_id", "fp"), radius, tile).withColumnRenamed("fp", "_fp")
    return rows.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def one_of_each(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The rows of docs, one for each component: that with the least doc_id (a null one only where there is no other)."""
    kept = {f"_keep_{c}": docs[c] for c in docs.columns if c != "text"}
    rows = stage(fingerprints(docs, size, keep=kept | {"_uid": F.monotonically_increasing_id()}, text_as="_keep_text"), "fingerprints")
    slim = rows.select("doc_id", "fp", "_uid")
    named = groups_of(slim, radius, tile).withColumnRenamed("fp", "_fp")
    best = slim.join(named, F.col("fp") == F.col("_fp")).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_uid")).alias("best"))
    chosen = stage(best.select(F.col("best._uid").alias("_chosen")), "chosen")
    # texts move by one shuffle at any size, not by a broadcast while the chosen rows are few
    return rows.join(chosen.hint("merge"), F.col("_uid") == F.col("_chosen"), "left_semi").select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash_components(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
