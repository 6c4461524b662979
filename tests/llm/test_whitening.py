"""Whitening against a plain version with exact integers."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening


def plain(vectors, components=32):
    """By the definition, centred with fractions before multiplying; numpy's singular values instead of eigenvectors."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dims)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(dims)) for r in x]
    centred = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(dims)] for r in x])
    u, s, vt = np.linalg.svd(centred / math.sqrt(n), full_matrices=False)
    k = min(components, int((s**2 > s[0] ** 2 * whitening.LEAST_SHARE).sum()))
    return deviation, centred @ vt[:k].T / s[:k], s[:k] ** 2 / (s**2).sum()


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.component) for k, v in out.items()}


def write(spark, tmp_path, rows, ddl="vec_id long, embedding array<float>, label int"):
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def same_up_to_sign(got, want):
    signs = np.sign((got * want).sum(0))
    assert np.allclose(got * signs, want, atol=1e-7, rtol=1e-7)


@pytest.mark.parametrize("block", [1024, 16])
def test_equals_plain(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    rng = np.random.default_rng(2)
    good = (rng.normal(size=(90, 40)) @ np.diag(np.geomspace(30, 0.5, 40))).astype(np.float32).tolist()
    good += good[:5]
    odd = [None, [], [None] * 40, good[0][:-1] + [float("nan")], [float("inf")] + good[0][1:], good[0][:-1]]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(1000 + i, v, 0) for i, v in enumerate(odd)]
    got = rows_of(whitening.op12_whitened_embeddings(spark, write(spark, tmp_path, rows)))
    deviation, want, explained = plain(good)
    assert sorted(got) == list(range(95)) and want.shape[1] == 32
    for i, r in got.items():
        assert [x.component for x in r] == list(range(1, 33)) and {x.n for x in r} == {95} and {x.deviation for x in r} == {deviation[i]}
    same_up_to_sign(np.array([[x.whitened for x in got[i]] for i in range(95)]), want)
    assert np.allclose([x.explained for x in got[0]], explained, rtol=1e-8)
    errors = {x.identity_error for r in got.values() for x in r}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-8


def test_given_rows(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    sound = [r for r in given if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    got = rows_of(whitening.op12_whitened_embeddings(spark, "/root/testdata/sf0.001"))
    deviation, want, explained = plain([r.embedding for r in sound])
    assert sorted(got) == sorted(r.vec_id for r in sound)
    assert {r.vec_id: d for r, d in zip(sound, deviation)} == {k: v[0].deviation for k, v in got.items()}
    same_up_to_sign(np.array([[x.whitened for x in got[r.vec_id]] for r in sound]), want)
    assert np.allclose([x.explained for x in got[sound[0].vec_id]], explained, rtol=1e-8)


def test_small_variance_beside_large_means(spark, tmp_path):
    rng = random.Random(1)
    vectors = [[1000.0 + rng.randint(0, 1) / 64, 5000.0 + rng.randint(0, 40) / 64, 0.0] for _ in range(60)]
    got = rows_of(whitening.op12_whitened_embeddings(spark, write(spark, tmp_path, [(i, v, 0) for i, v in enumerate(vectors)])))
    deviation, want, explained = plain(vectors)
    assert want.shape[1] == 2 and [len(r) for r in got.values()] == [2] * 60
    same_up_to_sign(np.array([[x.whitened for x in got[i]] for i in range(60)]), want)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)], [(1, None, 0)]])
def test_no_components(spark, tmp_path, rows):
    got = whitening.op12_whitened_embeddings(spark, write(spark, tmp_path, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []


def test_extreme_entries_and_null_ids(spark, tmp_path):
    rows = [(None, [3e38, 1.0], 0), (7, [-3e38, 2.0], 0), (7, [0.0, 3.0], 0), (7, [0.0, 3.0], 0)]
    got = rows_of(whitening.op12_whitened_embeddings(spark, write(spark, tmp_path, rows)))
    assert sorted(map(str, got)) == ["7", "None"] and len(got[7]) == 3 * len(got[None])
    assert {r.deviation for r in got[None]} == {None} and all(math.isfinite(r.whitened) for v in got.values() for r in v)
    other = spark.createDataFrame([("a", [1.0, 2.0], 1), ("b", [2.0, 5.0], 2), ("c", [4.0, 1.0], 3)], "name string, v array<double>, _row int")
    rows, fit = whitening.whiten(other, 1, "name", "v")
    assert rows.count() == 3 and fit.matrix.shape == (2, 1)
