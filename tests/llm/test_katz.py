"""The Katz model against a plain version, and its distributions' sums."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import katz
from tessera.llm.katz import Katz

TEXTS = ["a rose is a rose is a rose", "A Rose by\tany other name", "a rose", "", None, "is a rose a rose", "the name of the rose is the name", "Été été ÉTÉ", "  the  name\n\nof a  rose ", "x" * 300, "a rose is a rose is a rose", "name of the rose"]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Plain:
    """The model by its definition, with dictionaries of words."""

    def __init__(self, texts, model):
        self.model, self.n = model, defaultdict(Counter)
        for text in texts:
            line = ["<s>", *tokens(text)]
            for order in range(1, len(model.least) + 1):
                for i in range(order - 1, len(line)):
                    self.n[order][tuple(line[i - order + 1 : i + 1])] += 1
        self.begins = self.n[1].pop(("<s>",), 0)
        self.total, self.words = sum(self.n[1].values()), [w for (w,) in self.n[1]]
        self.share = {order: self.shares(order) for order in range(1, len(model.least) + 1)}

    def shares(self, order):
        k, m = self.model.most, self.model.least[order - 1]
        n = Counter(self.n[order].values())
        try:
            common = (k + 1) * n[k + 1] / (m * n[m])
            out = {r: ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(m, k + 1)}
            assert n[k + 1] and all(0 < x < 1 for x in out.values())
        except (ZeroDivisionError, AssertionError):
            out = {r: (r - 0.5) / r for r in range(m, k + 1)}
        return {r: out.get(r, 0.0) for r in range(k + 1)}

    def kept(self, order, count):
        return count * (self.share[order][count] if count <= self.model.most else 1.0)

    def p(self, gram):
        order = len(gram)
        if order == 1:
            lost = sum(c - self.kept(1, c) for c in self.n[1].values())
            whole = self.total if lost else self.total + 1
            c = self.n[1][gram]
            return self.kept(1, c) / whole if c else (lost + whole - self.total) / whole
        history = gram[:-1]
        seen = {g: self.kept(order, c) for g, c in self.n[order].items() if g[:-1] == history and self.kept(order, c)}
        whole = self.begins if history == ("<s>",) else self.n[order - 1][history]
        if whole and sum(seen.values()) >= whole:
            whole += 1
        if gram in seen:
            return seen[gram] / whole
        weight = (1 - sum(seen.values()) / max(whole, 1)) / (1 - sum(self.p(g[1:]) for g in seen))
        return weight * self.p(gram[1:])

    def score(self, text):
        line = ["<s>", *tokens(text)]
        most = len(self.model.least)
        return sum(math.log10(self.p(tuple(line[max(0, i - most + 1) : i + 1]) if most > 1 else (line[i],))) for i in range(1, len(line)))


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)


@pytest.mark.parametrize("model", [Katz(), Katz((1, 1, 1), 2), Katz((1, 2), 3), Katz((1,), 4), Katz((1, 1, 1, 1), 1), Katz((1, 1, 2, 2), 3)])
def test_scores_equal_plain_ones(spark, model):
    texts = TEXTS * 2 + [f"the rose {i % 5} of {i % 3} is a name {i % 7}" for i in range(40)]
    held = {i for i in range(len(texts)) if i % 4 == 1}
    got = {r.doc_id: r for r in katz.evaluated(frame(spark, texts), "doc_id % 4 = 1", model).collect()}
    plain = Plain([t for i, t in enumerate(texts) if i not in held], model)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        line = tokens(text)
        base = sum(math.log10((plain.n[1][(w,)] + 0.1) / (plain.total + 0.1 * (len(plain.words) + 1))) for w in line)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (i in held, len(line), sum((w,) in plain.n[1] for w in line), plain.total)
        assert got[i].base_score == pytest.approx(base, rel=1e-12, abs=1e-12)
        assert got[i].score == pytest.approx(plain.score(text), rel=1e-9, abs=1e-9)
    histories = {g[:-1] for order in plain.n for g in plain.n[order]}
    for history in histories:
        assert sum(plain.p((*history, w)) for w in [*plain.words, "no such word"]) == pytest.approx(1, abs=1e-9)


def test_given_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    learned = [r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10]
    plain = Plain(learned, Katz((1,)))
    got = {r.doc_id: r for r in katz.op13_katz_backoff(spark, "/root/testdata/sf0.001").collect()}
    assert {i for i, r in got.items() if r.held_out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10 == 0}
    for r in rows:
        base = sum(math.log10((plain.n[1][(w,)] + 0.1) / (plain.total + 0.1 * (len(plain.words) + 1))) for w in tokens(r.text))
        assert got[r.doc_id].base_score == pytest.approx(base, rel=1e-10)
    assert sum(r.score for r in got.values() if not r.held_out) > sum(r.base_score for r in got.values() if not r.held_out)


def test_odd_tables(spark):
    assert katz.evaluated(frame(spark, [])).collect() == []
    untrained = katz.evaluated(frame(spark, ["a b", None]), "true").collect()
    assert [(r.base_score, r.score, r.train_tokens, r.n_known) for r in untrained] == [(0.0, 0.0, 0, 0)] * 2
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = sorted(katz.evaluated(nulls, katz.HELD_OUT).collect(), key=lambda r: (r.doc_id is None, r.n_tokens))
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known) for r in got] == [(1, False, 3, 3)] * 2 + [(None, True, 4, 3)] * 2
    named = katz.evaluated(frame(spark, ["a b"]).selectExpr("cast(doc_id as string) id", "text body", "score held"), "id = 'x'".replace("id", "doc_id"), id_col="id", text_col="body").collect()
    assert named[0].doc_id == "0" and math.isfinite(named[0].score)


def test_long_texts_and_blocks(spark):
    """Texts of 10 MB, and the same scores however rows fall into blocks."""
    docs = frame(spark, ["la " * 3_400_000, "q" * 10_000_000, "la la q", "no"])
    got = {r.doc_id: r for r in katz.evaluated(docs, "doc_id = 3").collect()}
    assert got[0].n_tokens == 3_400_001 and got[1].n_tokens == 2 and math.isfinite(got[3].score)
    rows = frame(spark, [f"w{i % 13} w{i % 7} w{i % 3} end" for i in range(300)])
    one, many = ({r.doc_id: round(r.score, 9) for r in katz.evaluated(rows.repartition(n), "doc_id % 10 = 0").collect()} for n in (1, 7))
    assert one == many


def test_words_of_white_space():
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["", " ", "a", " a b c \x0b\x0cd\x1cE\r\n", None, "\tx"]
    places, ends, distinct = katz.words_of(pa.array(texts))
    words = [distinct[i] for i in places]
    assert words == [w for t in texts for w in tokens(t)[:-1]]
    assert ends.tolist() == [sum(len(tokens(t)) - 1 for t in texts[: i + 1]) for i in range(len(texts))]
    given = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks().slice(300, 400)
    at, stop, found = katz.words_of(given)
    assert [found[i] for i in at] == [w for t in given.to_pylist() for w in tokens(t)[:-1]] and len(stop) == 400
    sliced, stops, names = katz.words_of(pa.array(texts).slice(2, 3))
    assert [names[i] for i in sliced] == [w for t in texts[2:5] for w in tokens(t)[:-1]] and stops.tolist() == [1, len(sliced), len(sliced)]
