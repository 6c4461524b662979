"""The alignment of two vocabularies against a plain version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import alignment, bytepairs
from tessera.llm.spm import public_path

HARD = ["", None, " ", "a", "hello world", "hello  world\n\n\tx ", "▁under", "été ÉTÉ naïve", "日本語のテキスト", "🙂🙂 🙃", "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00\x01 nul", "a\r\nb", "１２３ ½", "é", "word " * 2000, " 　 x", "x" * 500]


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))


def byte_letters():
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others counted from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(coders, texts):
    """By the definition: lists of byte ranges, groups and links of each text, then counts over all texts."""
    a_coder, b_coder = coders
    letters = byte_letters()
    each = []
    for text in texts:
        groups, links, a, b = [], [], [], []
        if text:
            a = a_coder.encode(" " + text, add_special_tokens=False).ids
            b = b_coder.encode(text)
            a_raw = [bytes(letters[c] for c in a_coder.id_to_token(i)) for i in a]
            b_raw = [bytes([int(p[3:5], 16)]) if b_coder.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_coder.id_to_piece(i)]]
            if b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
                ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (a_raw, b_raw))
                i = j = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    ni, nj = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
                    groups.append((a[i:ni], b[j:nj]))
                    i, j = ni, nj
                links = [(g[0][-1], g[1][-1]) for g in groups]
            else:
                a = b = []
        each.append((a, b, groups, links))
    counts = Counter(link for *_, links in each for link in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for a, b, groups, links in each:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return out, counts, best


def results(df):
    return sorted(((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect()), key=lambda x: (x[0] is None, x))


def test_equals_plain(spark, coders, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)  # many blocks
    rng = random.Random(5)
    words = ["the", "Straße", "naïve", "x1", "don't", "  ", "\n", "▁", "日本", "🙂", "1234", "...", "END"]
    texts = HARD + ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += texts[4:60] + ["copied text of a large group"] * 500
    rows = [(i, t, 7, "x", "y") for i, t in enumerate(texts)] + [(None, "hello world", 7, "x", "y"), (3, "a", 7, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, copies string, n_a string").repartition(3)
    measures, pairs = alignment.aligned(docs)
    want, counts, best = plain(coders, [r[1] for r in rows])
    assert results(measures) == sorted(((r[0], w) for r, w in zip(rows, want)), key=lambda x: (x[0] is None, x))
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {k: (n, n == best[k[1]]) for k, n in counts.items()}


def test_given_rows(spark, coders):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = plain(coders, [r.text for r in rows])[0]
    assert results(alignment.op11_aligned_vocabularies(spark, "/root/testdata/sf0.001")) == sorted((r.doc_id, w) for r, w in zip(rows, want))


def test_odd_tables(spark, coders):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty)[0].collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert results(alignment.aligned(blank)[0]) == [(1, (0,) * 6 + ("",)), (2, (0,) * 6 + ("",)), (2, (0,) * 6 + ("",))]
    rows = [("a", "some words " * 900_000), ("b", " " * 10_000)]
    long = spark.createDataFrame(rows, "name string, body string")
    assert results(alignment.aligned(long, id_col="name", text_col="body")[0]) == sorted(zip("ab", plain(coders, [t for _, t in rows])[0]))


def test_ranks_encode_as_the_json_vocabulary(coders):
    ranks = bytepairs.BytePairs(public_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    texts = [" " + (t or "") for t in HARD] + [f" a{chr(c)}1{chr(c)} {chr(c)}b{chr(c)}{chr(c)}  {chr(c)}" for c in rng.sample([*range(0xD800), *range(0xE000, 0x110000)], 20_000)]
    texts += [" " + "".join(rng.choice("ab '\n\t 1.sé中 \r'") for _ in range(rng.randrange(60))) for _ in range(5000)]
    wide = [" " * 5000 + "x y", "a" + "\n" * 6000 + "b", "z" + " \n" * 3000, "\t" * 4097 + " " * 4097 + "'s " + " " * 9000]
    for text in texts + wide:
        assert ranks.encode(text).tolist() == coders[0].encode(text, add_special_tokens=False).ids, text[:50]


def test_runs_of_ten_million(coders):
    ranks = bytepairs.BytePairs(public_path("byte_bpe_multi_50k.tiktoken"))
    assert b"".join(ranks.tokens[i] for i in ranks.encode("x" + " " * 10_000_000 + "y")) == b"x" + b" " * 10_000_000 + b"y"
