"""Near-duplicates by SimHash and the exact Jaccard similarity of word shingles, for the pipeline's stage.

Texts with equal sets of shingles are merged first. SimHash, compared in tiles, finds the close pairs of what is left;
at the asked similarity (4/5) many pairs lie further apart than a radius of 64-bit fingerprints can reach without meeting
chance neighbours, so the rest of the links comes from prefixes: with all sets in one order, two sets of that
similarity share a shingle among the first n // 5 + 1 of each, so only these are spread out, and only those that two
texts share are kept. Shingles that a sample of the documents shows to be common come last in the order; the sample changes
the work alone, since any one order gives the same pairs.

A pair that meets in either way is first tried by sketches, the counts of its sets' shingles in equal ranges of hash values:
the sums of their minima are no less than the shingles they share, so pairs whose sums are too small go. What stays is checked over
both whole texts. Of those that share a shingle, all are checked against the one that has it first in its order before other pairs
are, and pairs that earlier links already connect need no check, so families of copies cost no quadratic work.

Defined results: as of simhash.one_of_each; null and wordless texts have the empty set and are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, map_slices, pick
from tessera.llm.simhash import SEED, components, fingerprint_of, links_within, shingle_hashes
from tessera.runtime import stage, unstage

SIZE = 5
#: The least similarity, as a fraction: whole numbers keep its edge exact.
ALIKE = (4, 5)
#: The share of the documents, and the least number, that show which shingles are common.
SAMPLE = 0.01
LEAST = 2_000
#: Most common shingles that are told apart by their frequency; rarer ones are ordered by their values.
COMMON = 200_000


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles."""
    return np.unique(shingle_hashes(text, size))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ALIKE."""
    return enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))


def enough(both, many_a, many_b):
    p, q = ALIKE
    return (p + q) * both >= p * (many_a + many_b)


def sketch(values: np.ndarray) -> bytes:
    """How many of a sorted set's hashes begin with each combination of so many bits that two to four fall on one; empty if one has too many to count."""
    bits = max(2, (len(values) // 4).bit_length())
    counts = np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(a: bytes, b: bytes) -> int | None:
    """At least as many as two sets share, from their sketches; None if one is empty."""
    if not a or not b:
        return None
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in sorted((a, b), key=len))
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())


def common_shingles(docs: DataFrame, size: int = SIZE, share: float = SAMPLE, least: int = LEAST) -> np.ndarray:
    """Shingles of three or more of the sampled documents, from rare to frequent; they only order the work."""
    n = docs.count()
    some = pick(docs, text=F.col("text").cast("string"))
    many = max(least, share * n)
    some = some.sample(fraction=many / n, seed=SEED) if n > many else some

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x or b"", size) for x in part.column("text").cast(pa.binary()).to_pylist()]
        h, counts = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(counts)], ["h", "n"])

    found = map_slices(some, "text", run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2")
    top = found.orderBy(F.col("n").desc(), "h").limit(COMMON).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def ordered(values: np.ndarray, names: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A sorted set with the common shingles (names, sorted, and their places) moved to the end."""
    if not len(names) or not len(values):
        return values
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    late = np.where(names[at] == values, places[at] + 1, 0)
    return values[np.argsort(late, kind="stable")]


def sketched(docs: DataFrame, common: np.ndarray, size: int, keep: dict, text_as: str) -> DataFrame:
    """doc_id, `keep`, the text, _set (a name of the shingle set), _n (its size), _fp (the fingerprint), _sketch and _prefix (its first shingles)."""
    names, places = np.sort(common), np.argsort(common)
    p, q = ALIKE

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for text in part.column("text").cast(pa.binary()).to_pylist():
            hashes = shingle_hashes(text or b"", size)
            values = np.unique(hashes)
            first = ordered(values, names, places)[: len(values) - -(-p * len(values) // q) + 1]
            for column, value in zip(out, (xxhash.xxh3_128_digest(values.tobytes()), len(values), fingerprint_of(hashes), sketch(values), first.view(np.int64))):
                column.append(value)
        other = [x for x in part.schema.names if x != "text"]
        more = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(np.array(out[2], np.uint64).view(np.int64)), pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*[part.column(x) for x in other], part.column("text"), *more], [*other, text_as, "_set", "_n", "_fp", "_sketch", "_prefix"])

    slim = pick(docs, doc_id="doc_id", text=F.col("text").cast("string"), **keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    return map_slices(slim, "text", run, f"{fields}, `{text_as}` string, _set binary, _n int, _fp long, _sketch binary, _prefix array<long>")


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that their sizes and sketches allow to be alike; sets: uid, n and sketch."""
    left, right = (sets.select(F.col("uid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter(enough(F.least("na", "nb"), F.col("na"), F.col("nb")))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        most = map(most_shared, part.column("sa").to_pylist(), part.column("sb").to_pylist())
        good = [m is None or enough(m, x, y) for m, x, y in zip(most, part.column("na").to_pylist(), part.column("nb").to_pylist())]
        return part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_slices(met.select("a", "b", "na", "nb", "sa", "sb"), "sa", run, "a long, b long")


def checked(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Those of the staged pairs (a, b) whose whole texts are alike; texts: uid and text. Staged."""
    some = stage(likely(pairs, sets), "shingle-likely")
    ids = stage(some.select(F.col("a").alias("_id")).unionByName(some.select(F.col("b").alias("_id"))).distinct(), "shingle-ids")
    met_at_all = broadcast_if_small(ids, 200_000)  # one number a row; only these texts move
    texts = texts.join(met_at_all, F.col("uid") == F.col("_id"), "left_semi")
    left, right = (texts.select(F.col("uid").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    met = some.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "ta", "tb")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        good, last, left = [], None, None  # sorted by a, which many pairs may share
        for a, b, text in zip(part.column("a").to_pylist(), part.column("tb").cast(pa.binary()), part.column("ta").cast(pa.binary())):
            if a != last:
                last, left = a, shingle_set(text.as_py() or b"", size)
            good.append(alike(left, shingle_set(b.as_py() or b"", size)))
        return part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = stage(map_slices(met, "tb", run, "a long, b long"), "shingle-links")
    for done in (some, ids):
        unstage(done)
    return out


def close_pairs(rows: DataFrame) -> DataFrame:
    """a, b: pairs of distinct sets whose fingerprints (fp) SimHash links, by the least uid of each fingerprint; rows: uid and fp."""
    least = stage(rows.groupBy("fp").agg(F.min("uid").alias("uid")), "shingle-fingerprints")
    links = links_within(least)
    of = lambda side: least.select(F.col("fp").alias(f"_{side}"), F.col("uid").alias(f"u{side}"))
    between = links.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b")).select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
    within = rows.select("uid", "fp").join(least.select(F.col("fp").alias("_fp"), F.col("uid").alias("a")), F.col("fp") == F.col("_fp")).filter("a < uid").select("a", F.col("uid").alias("b"))
    return stage(between.unionByName(within).distinct(), "shingle-close")


def links_of(rows: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """a, b: enough of the pairs of alike sets to span each component; rows: uid, n, fp, sketch and prefix of distinct sets; texts: uid and text of these at least."""
    sets = rows.select("uid", "n", "sketch")
    links = checked(close_pairs(rows), sets, texts, size)
    w = Window.partitionBy("h")
    spread = rows.select("uid", "n", F.posexplode("prefix").alias("at", "h"))
    # of those that share a shingle, the one with the fewest shingles before it is nearest to what they all come from
    shared = spread.withColumn("pivot", F.min(F.struct("at", "uid", "n")).over(w)).withColumn("many", F.count(F.lit(1)).over(w)).filter("many > 1").drop("many")
    shared = stage(shared, "shared-shingles")

    def with_roots(df: DataFrame, *columns: str) -> DataFrame:
        roots = stage(components(links), "shingle-roots")
        for c in columns:
            df = df.join(roots.select(F.col("node").alias("_node"), F.col("root").alias(f"root_{c}")), F.col(c) == F.col("_node"), "left").drop("_node").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        return df

    left = F.least(F.col("n") - F.col("at"), F.col("pivot.n") - F.col("pivot.at"))  # shingles that both can still share from here on
    near = shared.filter((F.col("uid") != F.col("pivot.uid")) & enough(left, F.col("n"), F.col("pivot.n")))
    stars = near.select(F.least("uid", "pivot.uid").alias("a"), F.greatest("uid", "pivot.uid").alias("b")).distinct()
    stars = stage(with_roots(stars, "a", "b"), "shingle-stars")
    links = links.unionByName(checked(stars.filter("root_a <> root_b").select("a", "b"), sets, texts, size))
    known = with_roots(shared.select("h", "uid", "n", "at"), "uid")
    x, y = (known.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("uid", "n", "at", "root_uid")]) for s in "xy")
    most = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    met = x.join(y, "h").filter((F.col("uid_x") < F.col("uid_y")) & (F.col("root_uid_x") != F.col("root_uid_y")) & enough(most, F.col("n_x"), F.col("n_y")))
    pairs = met.select(F.col("uid_x").alias("a"), F.col("uid_y").alias("b")).distinct()
    last = checked(stage(pairs.join(stars.select("a", "b"), ["a", "b"], "left_anti"), "shingle-pairs"), sets, texts, size)
    unstage(shared)
    unstage(stars)
    return links.unionByName(last)


def one_of_each(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs, one for each component of alike texts: that with the least doc_id (a null one only where there is no other)."""
    kept = {f"_keep_{c}": docs[c] for c in docs.columns if c != "text"} | {"_uid": F.monotonically_increasing_id()}
    rows = stage(sketched(docs, common_shingles(docs, size), size, kept, "_keep_text"), "shingles")
    sets = stage(rows.groupBy("_set").agg(F.min("_uid").alias("uid")), "shingle-sets")
    columns = {"uid": "_uid", "n": "_n", "fp": "_fp", "sketch": "_sketch", "prefix": "_prefix"}
    distinct = rows.join(sets.hint("merge"), F.col("_uid") == F.col("uid"), "left_semi").select(*[F.col(c).alias(name) for name, c in columns.items()])
    distinct = stage(distinct, "shingle-distinct")
    roots = stage(components(links_of(distinct, rows.select(F.col("_uid").alias("uid"), F.col("_keep_text").alias("text")), size)), "roots")
    unstage(distinct)
    named = sets.join(roots, F.col("uid") == F.col("node"), "left").select(F.col("_set").alias("_name"), F.coalesce("root", "uid").alias("group"))
    best = rows.select("doc_id", "_set", "_uid").join(named, F.col("_set") == F.col("_name")).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_uid")).alias("best"))
    chosen = stage(best.select(F.col("best._uid").alias("_chosen")), "chosen")
    return rows.join(chosen.hint("merge"), F.col("_uid") == F.col("_chosen"), "left_semi").select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])
