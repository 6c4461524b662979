"""The pipeline's stages against plain versions of them."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import pii, shingles, spm
from tessera.runtime import stage
from tests.llm.test_operators import corpus, frame, plain_components


@pytest.fixture(scope="module")
def stages(spark):
    docs = frame(spark, corpus(), more=False)
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], ""), name))
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mix_sources", "token_ids"]
    assert "pipeline" in corpus_pipeline.QUERIES


def test_columns_and_what_is_kept(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    counts = [s.count() for s in stages]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[4] == counts[5] > 0


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"], None, None) for r in stages[1].collect()]
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in stages[2].collect()) == sorted({c for _, _, c in plain_components(rows)})


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("n", [60, 300])
def test_near_copies_go_at_the_stage_law(spark, n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(n)]
        texts.append(base)
        for changes in (1, 2, 3, n // 40, n // 30, n // 12):
            copy = list(base)
            for at in rng.sample(range(n), changes):
                copy[at] = word()
            texts.append(copy)
    texts += [["licence"] * 3 + ["of", "all", "the", "many"] * 2 + [word() for _ in range(n)] for _ in range(20)]
    rows = [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)] + [(5000 + i, t, "en", "a") for i, t in enumerate([None, "", " \n", "one two", "ONE two"])]
    sets = [grams(t or "") for _, t, _, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = sorted({g: i for (i, *_), g in reversed(list(zip(rows, group)))}.values())
    docs = frame(spark, rows, more=False).repartition(5)
    assert sorted(r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()) == want
    assert len(want) < len(rows) - 40
    assert shingles.alike(np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)) and not shingles.alike(np.arange(8, dtype=np.uint64), np.arange(1, 9, dtype=np.uint64))


def test_personal_data_is_gone(spark):
    docs = frame(spark, [(1, "write to a@b.de now", "en", "a"), (2, None, "en", "a"), (3, "", "en", "a")], more=False)
    out = {r["doc_id"]: r for r in corpus_pipeline.STAGES[2][1](spark, docs, "").collect()}
    assert out[1]["text"] == "write to [EMAIL] now" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == ""
    assert not pii.base_spans(out[1]["text"])


def test_clashing_columns_come_along(spark):
    """Columns with the names that the stages use inside keep their values and change no decision."""
    names = ["_uid", "_set", "_n", "_prefix", "_fp", "_sketch", "_keep_text", "fp", "uid", "size", "spans", "base", "more", "kept", "reason", "group_name", "n_words", "entropy", "bands", "_taken", "_copy", "_size", "a", "b", "h"]
    rows = [r for r in corpus(60) if r[0] is not None]
    plain = frame(spark, list({r[0]: r for r in rows}.values()), more=False)
    wide = plain.select("*", *[(F.col("doc_id") * 100 + i).alias(c) for i, c in enumerate(names)])
    for name, function in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(function(spark, plain, ""), name), stage(function(spark, wide, ""), name)
        assert wide.columns == [*plain.columns, *names]
        got = wide.collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in plain.collect()) == sorted((r["doc_id"], r["text"] or "") for r in got)
        assert got and all(r[c] == r["doc_id"] * 100 + i for r in got for i, c in enumerate(names))


def test_ids(stages):
    codec = spm.codec(spm.public_path())
    want = sorted(codec.encode(r["text"] or "") for r in stages[4].collect())
    assert sorted(r["ids"] for r in stages[5].collect()) == want


def test_run_equals_the_stages(spark, tmp_path, stages):
    frame(spark, corpus(), more=False).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["ids_sha256"] for r in out.collect()) == sorted(r["ids_sha256"] for r in stages[5].collect())


def test_empty(spark):
    docs = frame(spark, [], more=False)
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, "")
    assert docs.collect() == []
    assert np.dtype("<u4").itemsize == 4
