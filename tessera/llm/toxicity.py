"""Toxicity grades by cumulative-link ordinal regression.

Texts become sparse features: the presence of their lower-cased words and of the words' longer
beginnings, hashed into buckets. Training takes a bounded
sample of labelled rows (`most_rows`, those with the least hash of their id). Toxic ones are graded 1 to 3 by terciles
of their rate of marked words (words whose odds of standing in a toxic text are far above the others'), clean ones are
0. The model gives P(grade <= j) = logistic(threshold_j - w . x) with one weight vector for all thresholds, fitted by
accelerated proximal gradient steps under an L1 penalty, so that few buckets keep a weight. Every document is then
scored whole: the expected severity is the sum over j of P(grade > j), and it is toxic if P(grade > 0) reaches a cut
chosen on held-out rows of the sample.

Defined results: a null or empty text has no features, so it gets the base severity and grade 0, as
every text without a feature that speaks for toxicity; labels of null are ignored and a
repeated id keeps its greatest label; with no toxic or no clean labelled row nothing can be learned and all get grade 0 and
severity 0; repeated rows are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEPT, map_slices, pick, texts_of
from tessera.llm.spm import LONGEST, REMEMBERED, Memo

WORDS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20
GRADES = 3
PREFIXES = (5, 6, 7)


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    thresholds: tuple[float, ...]
    cut: float = 0.5

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - np.asarray(score, float)[:, None], -50, 50)))


def bucket(word: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(word.encode()) % buckets


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def features_of(word: str, buckets: int = BUCKETS) -> tuple[int, ...]:
    """The buckets of a word and of its longer beginnings, which inflected and compound forms share."""
    return (bucket(word, buckets), *[bucket(f"{word[:k]}*", buckets) for k in PREFIXES if len(word) > k])


def _matrix(rows: list[np.ndarray], least: int, widest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, column numbers and the buckets of the columns, for buckets in `least` rows to `widest` of them."""
    flat = np.concatenate(rows)
    counts = np.bincount(flat, minlength=BUCKETS)
    good = (counts >= least) & (counts <= max(least, widest * len(rows)))
    keep = good[flat]
    column = (np.cumsum(good) - 1).astype(np.int32)
    return np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[keep], column[flat[keep]], np.nonzero(good)[0]


def grades_of(rows: list[np.ndarray], repeats: list[np.ndarray], lengths: list[int], toxic: np.ndarray, least: int) -> np.ndarray:
    """0 for clean rows; toxic ones by terciles of the share of their words that are marked."""
    n = [np.bincount(np.concatenate([np.zeros(0, np.int32), *[r for r, t in zip(rows, toxic) if t == k]]), minlength=BUCKETS) for k in (0, 1)]
    size = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    odds = np.log((n[1] + 0.5) / size[1]) - np.log((n[0] + 0.5) / size[0])
    marked = (n[1] >= least) & (odds > 3)
    rate = np.array([k[marked[r]].sum() / max(1, m) for r, k, m in zip(rows, repeats, lengths)])
    grades = np.zeros(len(rows), int)
    cuts = np.quantile(rate[toxic == 1], [1 / 3, 2 / 3])
    grades[toxic == 1] = 1 + np.searchsorted(cuts, rate[toxic == 1], side="left")
    return grades


def learn(rows: list[np.ndarray], repeats: list[np.ndarray], lengths: list[int], toxic: np.ndarray, least: int = 5, widest: float = 0.3, spared: float = 0.002) -> Model:
    """The model from distinct buckets (and their counts) of each text.

    A fifth of the rows is held out to choose the cut on P(grade > 0): the least one from 0.2 to 0.5 that keeps the
    share of clean rows above it at `spared` or less.
    """
    held = np.arange(len(rows)) % 5 == 4
    if len({*toxic[~held].tolist()}) < 2:
        held[:] = False
    if len({*toxic[~held].tolist()}) < 2:
        return Model({}, (50.0,) * GRADES)

    def part(of: list, mask: np.ndarray) -> list:
        return [x for x, m in zip(of, mask) if m]

    grades = grades_of(part(rows, ~held), part(repeats, ~held), part(lengths, ~held), toxic[~held], least)
    row, col, kinds = _matrix(part(rows, ~held), least, widest)
    w, thresholds = fit_ordinal(row, col, len(kinds), grades)
    model = Model({int(b): float(x) for b, x in zip(kinds, w) if x}, tuple(float(x) for x in thresholds))
    clean = part(rows, held & (toxic == 0))
    if not clean:
        return model
    weight = np.zeros(BUCKETS)
    weight[kinds] = w
    p = np.sort(model.chances(np.array([weight[r].sum() for r in clean]))[:, 0])
    bound = float(p[max(0, len(p) - 1 - int(spared * len(p)))])
    return Model(model.weights, model.thresholds, min(0.5, max(0.2, bound + 0.02)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, columns: int, grades: np.ndarray, penalty: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model on a sparse 0/1 matrix, by FISTA with restarts."""
    n, k = len(grades), GRADES

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, w[col], n)

    def back(g: np.ndarray) -> np.ndarray:
        return np.bincount(col, g[row], columns)

    v = np.ones(columns)
    norm = 1.0
    for _ in range(15):
        v = back(times(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1 / (0.3 * norm / n + 1e-3)
    above = np.array([(grades > j).mean() for j in range(k)]).clip(1 / n, 1 - 1 / n)
    thresholds = np.log((1 - above) / above)

    def loss(score: np.ndarray, t: np.ndarray) -> float:
        cum = 1 / (1 + np.exp(np.clip(np.concatenate([[-50], t, [50]])[None, :] - score[:, None], -50, 50) * -1))
        return float(-np.log(np.maximum(cum[np.arange(n), grades + 1] - cum[np.arange(n), grades], 1e-12)).mean())

    w = np.zeros(columns)
    y, momentum, last = w.copy(), 1.0, np.inf
    for i in range(steps):
        score = times(y)
        a = thresholds[None, :] - score[:, None]
        cum = 1 / (1 + np.exp(-np.clip(a, -50, 50)))
        full = np.concatenate([np.zeros((n, 1)), cum, np.ones((n, 1))], axis=1)
        here, before = full[np.arange(n), grades + 1], full[np.arange(n), grades]
        slope = back(-(here + before - 1)) / n  # of the loss, by the weights
        new = y - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y, w, momentum = new + (momentum - 1) / faster * (new - w), new, faster
        # thresholds: a Newton-like step on each, kept in order
        p = np.maximum(here - before, 1e-9)
        density = cum * (1 - cum)
        for j in range(k):
            pull = np.where(grades == j, density[:, j] / p, 0) - np.where(grades == j + 1, density[:, j] / p, 0)
            bend = (pull**2).mean() + 1e-6
            thresholds[j] += 0.2 * np.clip(pull.mean() / bend, -1, 1)
        thresholds = np.maximum.accumulate(thresholds + 1e-6 * np.arange(k))
        if i % 20 == 19:
            now = loss(times(w), thresholds) + penalty * float(np.abs(w).sum())
            if now > last:
                momentum, y = 1.0, w.copy()
            if abs(last - now) < 1e-7:
                break
            last = now
    return w, thresholds


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000, least: int = 5, widest: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model from at most `most_rows` labelled documents; their bucket counts are all that comes to the driver."""
    marked = pick(labels, _id=id_col, toxic=F.col(label_col).cast("int")).filter(F.col("_id").isNotNull() & F.col("toxic").isNotNull())
    marked = marked.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = pick(docs, doc_id=id_col, text=F.col(text_col).cast("string")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        buckets, counts, lengths = [], [], []
        for text in texts_of(part, "text"):
            found: dict[int, int] = {}
            words = words_of(text)
            for w in words:
                for b in features_of(w):
                    found[b] = found.get(b, 0) + 1
            keys = sorted(found)
            buckets.append(np.array(keys, "<i4").tobytes())
            counts.append(np.array([found[b] for b in keys], "<i4").tobytes())
            lengths.append(len(words))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary()), pa.array(lengths, pa.int64())], ["doc_id", "toxic", "buckets", "counts", "length"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    found = map_slices(texts, "text", run, f"doc_id {kind}, toxic int, buckets binary, counts binary, length long").orderBy(F.xxhash64("doc_id"), "doc_id", "buckets").limit(most_rows).collect()
    toxic = np.array([min(1, max(0, r["toxic"])) for r in found], int)
    if not len(found) or toxic.min() == toxic.max():
        return Model({}, (50.0,) * GRADES)
    rows, repeats = ([np.frombuffer(r[c], "<i4") for r in found] for c in ("buckets", "counts"))
    return learn(list(rows), list(repeats), [r["length"] for r in found], toxic, least, widest)


_MEMORY: dict[str, Memo] = {}
KEPT["severity"] = _MEMORY.clear


def word_memory(name: str, weights: dict[int, float]) -> Memo:
    """The weighed buckets of the words that this worker has met for a model; only the last model's are kept."""
    if name not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[name] = Memo(lambda w: tuple(b for b in features_of(w) if b in weights), REMEMBERED, LONGEST)
    return _MEMORY[name]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, grade, expected_severity and toxic of every row."""
    weights = model.weights
    name = uuid.uuid4().hex  # of this model's memory in a worker, which serves one task after the other

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        memo = word_memory(name, weights)
        sums, evidence = [], []
        for text in texts_of(part, "text"):
            seen = {b for w in set(words_of(text)) for b in memo[w]}
            sums.append(sum(weights[b] for b in sorted(seen)))
            evidence.append(any(weights[b] > 0 for b in seen))
        above, evidence = model.chances(np.array(sums)), np.array(evidence, bool)
        toxic = (above[:, 0] >= model.cut) & evidence
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.where(toxic, np.maximum((above >= 0.5).sum(axis=1), 1), 0), pa.int32()), pa.array(np.round(above.sum(axis=1), 6)), pa.array(toxic)],
            ["doc_id", "grade", "expected_severity", "toxic"],
        )

    slim = pick(docs, doc_id=id_col, text=F.col(text_col).cast("string"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_slices(slim, "text", run, f"doc_id {kind}, grade int, expected_severity double, toxic boolean", uses="severity")


def op9_ordinal_severity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
