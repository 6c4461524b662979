"""The motif that tells labelled sequences apart."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import motifs


def sequences(n, seed, word="TGACTCA"):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        s = list(rng.choice(list("ACGT"), 60))
        if i % 2:
            at = rng.integers(0, 50)
            s[at : at + len(word)] = [c if rng.random() < 0.92 else "A" for c in word]
        rows.append(("".join(s), bool(i % 2)))
    return rows


def plain(rows, theta, bias, bg):
    pwm = np.exp(theta) / np.exp(theta).sum(1, keepdims=True)
    total = 0.0
    for text, y in rows:
        odds = [np.prod([pwm[k, "ACGT".index(c)] / bg["ACGT".index(c)] for k, c in enumerate(text[i : i + len(pwm)])]) for i in range(len(text) - len(pwm) + 1) if "N" not in text[i : i + len(pwm)]]
        n = max(len(text) - len(pwm) + 1, 1)
        p = (x := np.exp(bias) * (sum(odds) / n if odds else 1.0)) / (1 + x)
        total += np.log(p if y else 1 - p)
    return total


def test_value_and_gradient(spark):
    rows = sequences(30, 1) + [("ACNNACGTACGT", True), ("AC", False), ("NNNNNNNNN", True)]
    d = spark.createDataFrame([*rows, (None, True), ("ACGTACGT", None)], "text string, label boolean").repartition(3)
    theta, bg = np.random.default_rng(2).normal(size=(5, 4)), np.array([0.3, 0.2, 0.2, 0.3])
    value, slope = motifs.conditional(d, theta, 0.4, bg)
    assert value == pytest.approx(plain(rows, theta, 0.4, bg))
    for i in range(theta.size + 1):
        h = np.zeros(theta.size + 1)
        h[i] = 1e-5
        up, down = (plain(rows, theta + s * h[:-1].reshape(theta.shape), 0.4 + s * h[-1], bg) for s in (1, -1))
        assert slope[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)
    assert motifs.conditional(d.limit(0), theta, 0.4, bg)[0] == 0.0


def test_the_planted_word_comes_back(spark):
    d = spark.createDataFrame(sequences(300, 3), "text string, label boolean").repartition(3).cache()
    pwm, bias, value = motifs.fit_conditional(d, motifs.from_consensus("TGACACA", 0.5), rounds=25)
    assert "".join("ACGT"[i] for i in pwm.argmax(1)) == "TGACTCA" and value > 300 * np.log(0.5) * 0.5
    bg = motifs.background(d)
    fresh = sequences(200, 9)
    right = 0
    for text, y in fresh:
        codes = np.array(["ACGT".index(c) for c in text])
        right += (motifs._odds(np.log(pwm + 1e-9), bg, codes)[0] + bias > 0) == y
    assert right > 170
