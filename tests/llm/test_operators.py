"""The corpus operators against plain versions, with the hard cases: nulls, empties, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import html_text, mixing, pii, quality, sharding, simhash, spm, suffix_dedup, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns with the names that the operators use inside.
CLASH = ", fp long, size long, _uid long, spans string, kept string, rank int, group string"


def frame(spark, rows, more=True):
    """doc_id, text, lang, source with extra columns of clashing names."""
    full = [(i, t, la, s, None if t is None else len(t), *([7, 7, 7, "x", "x", 7, "x"] if more else [])) for i, t, la, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + (CLASH if more else ""))


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "été", "straße", "ou", "the", "of", "日本", "x1"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 60, 120])))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["b", "a", "c", None, "é"])))
    rows += [rows[3], rows[40], (None, "null id", "en", "a"), (n + 1, None, None, None), (n + 2, "", "en", "a"), (n + 3, " \n\t ", "en", "a"), (n + 4, "word " * 30_000, "en", "b")]
    rows += [(1000 + i, rows[10][1] + f" tail{i % 3}", "en", "a") for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).limit(0)


def collected(df):
    return [r.asDict() for r in df.collect()]


# -- personal data -----------------------------------------------------------------------------------------------------

PII_TEXTS = [
    "mail a.b@c.de, again x@y and +1 (555) 123-4567 or 300.1.1.1 and 10.0.0.255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, @ a@b.c@d.e é@ü.de",
    'api_key = "0123456789abcdef0123456789abcdef" by john (at) example (dot) com',
    "My name is Anna Berg, SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00",
    "", None, "nothing here", "1" * 5000,
]


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(4)
    texts = [t or "" for t in PII_TEXTS] + ["".join(rng.choice("ab@..+-() é0123456789012345678901") for _ in range(rng.randint(0, 70))) for _ in range(4000)]
    for text in texts:
        spans = pii.base_spans(text)
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        counts, digest = pii.brute_digest(text)
        assert hashlib.sha256(line.encode()).hexdigest() == digest
        assert sum(counts.values()) == len(spans)


def test_personal_data(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(PII_TEXTS)] * 3
    out = collected(pii.digest(pii.find_personal_data(frame(spark, rows))))
    assert len(out) == len(rows)
    for r in out:
        counts, digest = pii.brute_digest(PII_TEXTS[r["doc_id"]])
        assert r["base_sha256"] == digest
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [counts[k] for k in pii.BASE_KINDS]
    by = {r["doc_id"]: r["spans"] for r in out}
    assert "secret:11:43" in by[2] and "email:48:" in by[2]
    assert "name:11:20" in by[3] and "ssn:" in by[3] and "iban:" in by[3]
    assert by[4] == by[5] == by[6] == ""


PATTERNS = {("ssn", "+0++++"): 400, ("ssn", "+0-+++"): 50, ("card", "--0-++"): 300, ("card", "+0+-++"): 30}


def test_labelers_are_weighed_by_agreement():
    p = pii.soft_labels(PATTERNS)
    assert p["ssn", "+0++++"] > 0.9 > 0.5 > p["card", "--0-++"]
    assert pii.soft_labels({}) == {}


def plain_soft_labels(counts, rounds=100):
    """Expectation-maximisation, pattern by pattern."""
    kinds, labelers = sorted({k for k, _ in counts}), range(len(pii.LABELERS))
    prior = {k: 0.5 for k in kinds}
    chance = {(j, c, v): {"-": (0.45, 0.2), "0": (0.35, 0.35), "+": (0.2, 0.45)}[v][c] for j in labelers for c in (0, 1) for v in "-0+"}

    def posterior(kind, vote):
        yes, no = prior[kind], 1 - prior[kind]
        for j in labelers:
            yes, no = yes * chance[j, 1, vote[j]], no * chance[j, 0, vote[j]]
        return yes / (yes + no)

    for _ in range(rounds):
        p = {k: posterior(*k) for k in counts}
        before, prior = prior, {}
        for kind in kinds:
            of = [k for k in counts if k[0] == kind]
            prior[kind] = (sum(p[k] * counts[k] for k in of) + 1) / (sum(counts[k] for k in of) + 2)
        sums = {(j, c, v): {"-": (2, 1), "0": (1, 1), "+": (1, 2)}[v][c] + sum(n * (p[k] if c else 1 - p[k]) for k, n in counts.items() if k[1][j] == v) for j, c, v in chance}
        chance = {(j, c, v): x / sum(sums[j, c, u] for u in "-0+") for (j, c, v), x in sums.items()}
        if max(abs(prior[k] - before[k]) for k in kinds) < 1e-9:
            break
    return {k: posterior(*k) for k in counts}


def test_reliabilities_equal_plain_ones():
    rng = random.Random(13)
    for counts in (PATTERNS, {(rng.choice(pii.KINDS), "".join(rng.choice("-0+") for _ in pii.LABELERS)): rng.randint(1, 90) for _ in range(40)}):
        want = plain_soft_labels(counts)
        assert pii.soft_labels(counts) == pytest.approx(want, abs=1e-6)


def test_span_classifier_is_at_its_optimum():
    rng = random.Random(14)
    rows = [sorted({0, *[rng.randrange(1, 40) for _ in range(5)]}) for _ in range(300)]
    labels = [0.9 if 7 in r or rng.random() < 0.1 else 0.2 for r in rows]
    w = pii.fit_classifier(rows, labels)
    slope = w.copy()  # of the penalty and, row by row, of the loss
    for r, y in zip(rows, labels):
        slope[r] += 1 / (1 + np.exp(-w[r].sum())) - y
    assert np.abs(slope).max() < 1e-3 and w[7] > 1
    assert not pii.fit_classifier([], []).any()


def test_added_spans_equal_plain_ones(spark):
    rng = random.Random(15)
    parts = ["call 555-123-4567 now", "SSN 123-45-6789", "no 000-12-3456 here", "john (at) example (dot) com", 'token = "abcdef0123456789ab"', "password: hunter2hunter2", "my name is Anna Berg", "Dr. Who", "IBAN DE89 3704 0044 0532 0130 00", "card 1234 5678 9012 3456", "MAC 00:1b:63:84:45:e6", "a@b.de", "plain words only", "ref 12-345-6789"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(120)]
    found = [(pii.base_spans(t), pii.candidate_spans(t, pii.base_spans(t))) for t in texts]
    counts = {}
    for _, more in found:
        for kind, _, _, vote, _ in more:
            counts[kind, vote] = counts.get((kind, vote), 0) + 1
    labels = plain_soft_labels(counts)
    rows = [(f, labels[kind, vote]) for _, more in found for kind, _, _, vote, f in more]
    w = pii.fit_classifier([f for f, _ in rows], [y for _, y in rows])
    want = {i: sorted([*base, *[(s, e, kind) for kind, s, e, _, f in more if sum(w[b] for b in f) >= 0]]) for i, (base, more) in enumerate(found)}
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in collected(pii.find_personal_data(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])))}
    assert got == want
    assert sum(len(s) > len(b) for s, (b, _) in zip(want.values(), found)) > 40


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1." * 500_000, "@" * 1_000_000, "a@" * 500_000, "+1" * 500_000, "1 " * 500_000, "key=" * 250_000, "1-" * 500_000])
def test_hostile_texts_end(text):
    start = time.time()
    pii.candidate_spans(text, pii.base_spans(text))
    assert time.time() - start < 20


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.2.3", "1." + "0" * 100_000 + "." + "0" * 9 + "7.255", "9" * 5000 + ".1.2.3", "0.0.0.0"])
def test_addresses_with_runs_of_zeros(text):
    parts = text.split(".")
    good = all(p.strip("0") == "" or len(p.lstrip("0")) < 4 and int(p.lstrip("0")) < 256 for p in parts)
    assert [s for s in pii.base_spans(text) if s[2] == "ip"] == ([(0, len(text), "ip")] if good else [])


def test_long_secrets_are_taken_whole(spark):
    secrets = ["Zq9-" * 2500, "sk-" + "aB3" * 100, "ghp_" + "x7Q" * 60]
    texts = [f"password = {secrets[0]} and text", f"the {secrets[1]} here", f"the {secrets[2]} here"]
    for text, secret in zip(texts, secrets):
        found = [(a, b) for kind, a, b, *_ in pii.candidate_spans(text, pii.base_spans(text)) if kind == "secret"]
        assert [text[a:b] for a, b in found] == [secret]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts + [f"password = {'Zq9-' * 4}k and text number {i}" for i in range(60)] + texts[:1])]
    out = [r["text"] for r in pii.redact_documents(frame(spark, rows)).collect()]
    assert len(out) == len(rows) and not any("Zq9-" in t for t in out)  # the other two are left to the classifier, found whole or not at all
    assert all(texts[i] in out or not any(x in t for t in out for x in (secrets[i][5:40],)) for i in (1, 2))


def test_redaction():
    assert pii.redact("abc def ghi", [(4, 7, "name"), (5, 9, "email")]) == "abc [NAME]hi"


def test_personal_data_of_nothing(empty):
    assert pii.digest(pii.find_personal_data(empty)).collect() == []
    assert pii.redact_documents(empty).columns == empty.columns


# -- sharding ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    there = sharding.permute(np.arange(n), n)
    assert sorted(there.tolist()) == list(range(n))
    assert (sharding.permute(there, n, inverse=True) == np.arange(n)).all()


def test_shards(spark, docs, rows):
    out = collected(sharding.shard_documents(docs))
    assert len(out) == len(rows)
    per = {}
    for r in out:
        per.setdefault(r["shard"], []).append(r["slot"])
        assert sharding.row_number_at(r["shard"], r["slot"], len(rows)) == r["row_number"]
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert want == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out)
    again = collected(sharding.shard_documents(docs.repartition(3)))
    key = lambda r: tuple(-1 if v is None else v for v in r.values())
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_shards_of_nothing(empty):
    assert sharding.shard_documents(empty).collect() == []


# -- top k -------------------------------------------------------------------------------------------------------------


def plain_topk(rows, k, every):
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(sound):
        if i is not None and i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(sound) if b != a and len(w) == len(v))
            out += [(i, r + 1, None if n else j, -s) for r, (s, n, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def as_stored(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("shard_rows", [16, 1 << 15])
def test_topk(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(150)]
    rows += [(20, rows[20][1]), (7, rows[7][1]), (200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (None, [1.0] * 6), (None, rows[20][1]), (205, [1.0, 2.0]), (220, [2.0, 2.0]), (240, []), (242, [])]
    df = spark.createDataFrame([(i, v, 5, "x", 9) for i, v in rows], "vec_id long, embedding array<float>, score int, block string, uid int").repartition(4)
    want = plain_topk(as_stored(rows), 9, 20)
    assert sorted(map(tuple, topk.top_k(df, k=9, every=20, shard_rows=shard_rows).collect()), key=str) == want
    assert topk.top_k(df.limit(0)).collect() == []


def test_waves_of_shards(spark, monkeypatch):
    """Many shards in clusters, small blocks and slices: later waves are pruned, and nothing is lost."""
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "SLICE", 2)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 0.3 + (i // 40) * (1 if i % 80 < 40 else -1)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = topk.top_k(df, k=5, every=10, shard_rows=40)
    assert sorted(map(tuple, got.collect()), key=str) == plain_topk(as_stored(rows), 5, 10)


def test_too_large_components(spark):
    rng = random.Random(5)
    values = [1e15, -1e15, 2.0**53 + 2, 3e8, -7e8, 1.0, -0.01, 0.3, 12345678901.25]
    rows = [(i, [rng.choice(values) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    within = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    for shard_rows in (7, 1 << 15):
        got = {(r["query_id"], r["rank"]): r["score"] for r in topk.top_k(df, k=39, every=4, shard_rows=shard_rows).collect()}
        assert got == {(q, r): within(s) for q, r, _, s in plain_topk(rows, 39, 4)}


# -- sentencepiece -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=spm.public_path())


def test_codec_equals_the_library(library, rows):
    codec = spm.codec(spm.public_path())
    rng = random.Random(5)
    signs = "abcdethon ing  \n\t▁éñ1234.,!?<>&|²»日本語😀\u0000﻿"
    texts = [t or "" for _, t, _, _ in rows] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [" " * k + s for k in range(40) for s in ("", "x", "1", "\n")]
    for text in texts:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)


def test_decoding_any_ids(library):
    codec = spm.codec(spm.public_path())
    rng = random.Random(6)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.choice([0, 1, 2, 259, 28705])]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_pair_test_by_definition():
    codec = spm.codec(spm.public_path())
    rng = random.Random(7)
    normal = list(codec.normal.values())
    for _ in range(4000):
        a, b = rng.choice(normal), rng.choice(normal)
        assert codec._fit(a, b) == (codec._merge(codec.pieces[a] + codec.pieces[b]) == [a, b])


def test_encoded_documents(docs, rows, library, empty):
    out = collected(spm.encode_documents(docs, with_ids=True, with_text=True))
    want = sorted((str(i), library.encode(t or "", add_bos=True, add_eos=True)) for i, t, _, _ in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in out) == want
    for r in out:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(r["ids"]).encode()).hexdigest()
    assert spm.encode_documents(empty).collect() == []


# -- web pages ---------------------------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>gone</p> --><div class="ad">Buy now, cheap!</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b> text,<br>with &eacute; and &amp;amp;.<p>Second one.
<ul><li>item one<li>item two</ul><aside>side</aside><table><tr><td>cell</table><div class="user-comments"><p>Nice!</p></div></article>
<form>your mail <input></form><footer>&copy; me</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst bold text, with é and &amp;.\n\nSecond one.\n\nitem one\n\nitem two\n\ncell"


def test_pages_without_an_article():
    page = '<div id=menu>Home About</div><div class="text"><p>One sentence, and more. It goes on, yes.</p><p>Another sentence; it is here, too.</p></div><div class="cookie-notice">We use cookies, ok?</div>'
    assert html_text.main_text(page) == "One sentence, and more. It goes on, yes.\n\nAnother sentence; it is here, too."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<nav>x</nav>", ""), ("plain words", "plain words"), ("<p>a<script>", "a"), ("<p>a<!-- b", "a"), ("</p></div>x</b>", "x"), ("a < b", "a < b")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "<p>" + "word, " * 50_000, "z")], "page_id long, url string, html string, text string")
    out = collected(html_text.extract(df))
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_text.extract(df.limit(0)).collect() == []


# -- quality -----------------------------------------------------------------------------------------------------------


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_base(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) + rng.choice(["", "\nx y\nx y\n \n", " ## $", " "]) for _ in range(60)] + [None, "", "é " * 60, "\x0b\x0c", "a b " * 55]
    out = collected(quality.quality(frame(spark, [(i, t, rng.choice(["en", None]), "a") for i, t in enumerate(texts)])))
    assert len(out) == len(texts)
    for r in out:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == plain_base(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_quality_bands(spark):
    rng = random.Random(9)
    words = [a + b for a in ("the", "ing", "re", "on", "an", "est", "and", "of", "ment", "able") for b in ("ter", "ly", "er", "ed", "house", "way", "time", "work", "day", "light")]
    good = [(i, " ".join(rng.choice(words) for _ in range(200)), "en", "a") for i in range(150)]
    junk = [(1000 + i, " ".join(rng.choice(words) + rng.choice(["***", "&&&", "%%%"]) for _ in range(200)), "en", "a") for i in range(10)]
    codes = [(2000 + i, " ".join("%032x" % rng.getrandbits(128) for _ in range(60)), "en", "a") for i in range(10)]
    out = {r["doc_id"]: r for r in collected(quality.quality(frame(spark, good + junk + codes)))}
    assert all(out[i]["kept"] for i, *_ in good)
    assert not any(out[i]["kept"] for i, *_ in junk + codes)


def test_entropy_is_judged_among_texts_of_like_length(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(4, 8))) for _ in range(400)]
    good = [(i, " ".join(rng.choice(words) for _ in range((60, 200, 900, 6000)[i % 4])), "en", "a") for i in range(200)]
    dull = [(1000 + i, " ".join(rng.choice(words[8 * i : 8 * i + 12]) for _ in range(200)), "en", "a") for i in range(6)]
    out = {r["doc_id"]: r for r in collected(quality.quality(frame(spark, good + dull)))}
    assert all(out[i]["kept"] for i, *_ in good)
    assert [out[i]["reason"] for i, *_ in dull] == ["low_entropy"] * 6


def test_a_small_group_is_judged_by_its_own_kind(spark):
    rng = random.Random(11)
    latin = ["the", "water", "house", "other", "people", "between", "under", "never", "small", "work", "light", "number", "always", "every", "right"]
    greek = ["νερό", "σπίτι", "άλλο", "άνθρωποι", "ανάμεσα", "κάτω", "ποτέ", "μικρό", "δουλειά", "φως", "αριθμός", "πάντα", "κάθε", "σωστό", "ημέρα"]
    text = lambda words: " ".join(rng.choice(words) for _ in range(200))
    rows = [(i, text(latin), "en", "a") for i in range(80)] + [(1000 + i, text(greek), ("el", None)[i % 2], "a") for i in range(6)]
    few = [(2000 + i, text(latin), "de", "a") for i in range(20)] + [(3000, " ".join(rng.choice(latin) + rng.choice(["***", "&&&", "%%%"]) for _ in range(200)), "de", "a")]
    out = {r["doc_id"]: r for r in collected(quality.quality(frame(spark, rows + few)))}
    assert [i for i, r in out.items() if not r["kept"]] == [3000]


def test_measures_equal_plain_ones(spark):
    """Both vocabularies by their libraries' plain calls; long texts, repeated rows, wide white space."""
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=spm.public_path())
    with open(public_tokenizers.path(quality.PAIRS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "x", "some plain words here", "日本語 😀 été", "word " * 60_000, "a" + " " * 250_000 + "b", "ab" * 100_000, "some plain words here"]
    out = collected(quality.measure(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])))
    assert len(out) == len(texts)
    token = {i: b for b, i in ranks.items()}
    broken = lambda b: b != b.decode(errors="ignore").encode()
    for r in out:
        text = texts[r["doc_id"]] or ""
        for name, ids, part in (("", pieces.encode(text), pieces.is_byte), ("_pairs", pairs.encode_ordinary(text), lambda i: broken(token[i]))):
            n = len(ids)
            assert r[f"n_tokens{name}"] == n
            if n:
                shares = [ids.count(i) / n for i in set(ids)]
                assert r[f"chars_per_token{name}"] == pytest.approx(len(text) / n)
                assert r[f"byte_share{name}"] == pytest.approx(sum(map(part, ids)) / n)
                assert r[f"entropy{name}"] == pytest.approx(-sum(p * math.log2(p) for p in shares) / math.log2(n) if n > 1 else 1.0)


def test_quality_of_nothing(empty):
    assert quality.quality(empty).collect() == []
    assert quality.keep_sound(empty).columns == empty.columns


# -- near-duplicates ---------------------------------------------------------------------------------------------------


def plain_components(rows):
    def fp(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fp(t) for _, t, _, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    names = {}
    for g, (i, *_) in zip(group, rows):
        if i is not None:
            names[g] = min(names.get(g, i), i)
    return sorted((-1 if i is None else i, f"{f:016x}", names.get(g, -1)) for (i, *_), f, g in zip(rows, fps, group))


@pytest.mark.parametrize("tile", [8, 1 << 14])
def test_near_duplicates(docs, rows, tile):
    out = simhash.near_duplicates(docs, tile=tile)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], f"{r['fp'] % 2**64:016x}", -1 if r["component_id"] is None else r["component_id"]) for r in collected(out))
    assert got == plain_components(rows)


def test_comparison_within_and_between_tiles():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = a[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    for x, y in ((np.concatenate([a, near]), None), (a, near)):
        both = x if y is None else np.concatenate([x, y])
        order = lambda v: v[np.lexsort(simhash._parts(v).T[::-1])]
        found = simhash.compare(order(x), None if y is None else order(y), sub=16)
        links = {frozenset((int(p), int(q))) for i, p in enumerate(x) for q in (both[i + 1 :] if y is None else y) if bin(int(p) ^ int(q)).count("1") <= 3}
        assert {frozenset(f) for f in found} <= links
        parent = {int(v): int(v) for v in both}

        def root(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for p, q in found:
            parent[root(p)] = root(q)
        assert all(len({root(v) for v in link}) == 1 for link in links)


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (100, 100)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_one_of_each(docs, rows, empty):
    kept = collected(simhash.one_of_each(docs))
    names = [c for _, _, c in plain_components(rows)]
    assert len(kept) == len(set(names))
    assert {-1 if r["doc_id"] is None else r["doc_id"] for r in kept} == set(names)
    assert simhash.one_of_each(docs).columns == docs.columns
    assert simhash.near_duplicates(empty).collect() == []


# -- mixing ------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.remove(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_mix(docs, rows, empty):
    out = collected(mixing.mix(docs))
    assert len(out) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    targets = plain_targets(sizes)
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    key = lambda r: tuple("" if v is None else str(v) for v in r.values())
    assert sorted(map(key, out)) == sorted(map(key, collected(mixing.mix(docs.repartition(2)))))
    assert mixing.mix(empty).collect() == []


def test_mixed_documents(docs, rows):
    out = collected(mixing.mixed_documents(docs))
    words = {}
    for r in out:
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    targets = plain_targets(sizes)
    assert all(abs(words.get(s, 0) - targets[s]) <= 0.5 for s in sizes)
    texts = {t for _, t, _, _ in rows}
    assert all(r["text"] in texts or any((t or "").startswith(r["text"]) for t in texts) for r in out)


def test_mix_keeps_clashing_columns(spark, docs):
    names = ["_uid", "_taken_uid", "_taken", "_size", "_whole", "_part", "_copy", "_key", "_row", "_before_all", "_first", "taken", "budget", "target", "source_size", "_keep_text"]
    plain = docs.select("doc_id", "text", "source", "n_chars").filter("doc_id is not null").dropDuplicates(["doc_id"])
    wide = plain.select("*", *[(F.col("doc_id") * 100 + i).alias(c) for i, c in enumerate(names)])
    out = collected(mixing.mixed_documents(wide))
    assert out and mixing.mixed_documents(wide).columns == wide.columns
    assert all(r[c] == r["doc_id"] * 100 + i for r in out for i, c in enumerate(names))
    key = lambda r: (r["doc_id"], r["text"], r["n_chars"])
    assert sorted(map(key, out)) == sorted(map(key, collected(mixing.mixed_documents(plain))))


# -- toxicity ----------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(10)
    plain = ["w%s" % "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bad = ["nasty", "vile", "awful", "horrid"]

    def doc(i):
        toxic = int(rng.random() < 0.2)
        words = [rng.choice(plain) for _ in range(60)]
        for _ in range(rng.randint(3, 12) if toxic else 0):
            words[rng.randrange(60)] = rng.choice(bad)
        return i, " ".join(words), toxic

    all_ = [doc(i) for i in range(1500)]
    docs = frame(spark, [(i, t, "en", "a") for i, t, _ in all_] + [(5000, None, None, None), (5001, "", "en", "a"), (None, "vile " * 9, "en", "a")])
    labels = spark.createDataFrame([(i, x) for i, _, x in all_[:900]] + [(900_000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in collected(toxicity.score(docs, toxicity.train(docs, labels)))}
    held = all_[900:]
    assert sum(out[i]["toxic"] == bool(x) for i, _, x in held) >= 0.97 * len(held)
    assert out[5000]["grade"] == out[5001]["grade"] == 0
    grades = {g: np.mean([sum(w in bad for w in t.split()) for i, t, _ in held if out[i]["grade"] == g] or [0]) for g in range(4)}
    assert grades[0] < grades[1] <= grades[3]
    assert all(0 <= r["expected_severity"] <= 3 for r in out.values())


def plain_loss(rows, grades, w, thresholds, penalty):
    """The mean negative log-likelihood of the cumulative-link model and the penalty, row by row."""
    total = 0.0
    for cols, grade in zip(rows, grades):
        score = sum(w[c] for c in cols)
        below = lambda j: 0.0 if j < 0 else 1.0 if j >= len(thresholds) else 1 / (1 + math.exp(score - thresholds[j]))  # noqa: B023, E731
        total -= math.log(max(below(grade) - below(grade - 1), 1e-12))
    return total / len(rows) + penalty * sum(map(abs, w))


def test_ordinal_fit_is_as_good_as_a_plain_one():
    rng = random.Random(16)
    rows = [[c for c in range(4) if rng.random() < 0.4] for _ in range(250)]
    grades = [max(0, min(3, round(2.0 * (0 in r) + 1.2 * (1 in r) - 1.0 * (2 in r) + rng.gauss(0, 0.8)))) for r in rows]
    penalty = 0.01
    row = np.repeat(np.arange(250), [len(r) for r in rows])
    w, t = toxicity.fit_ordinal(row, np.array([c for r in rows for c in r]), 4, np.array(grades), penalty=penalty, steps=2000)
    # plain: each number in turn moves while that lowers the loss
    x, step = [0.0] * 4 + [-1.0, 0.0, 1.0], [0.5] * 7
    value = lambda v: plain_loss(rows, grades, v[:4], v[4:], penalty) if v[4] <= v[5] <= v[6] else math.inf
    best = value(x)
    while max(step) > 1e-3:
        for i in range(7):
            tries = [(value([*x[:i], x[i] + d, *x[i + 1 :]]), x[i] + d) for d in (-step[i], step[i])]
            if min(tries)[0] < best:
                best, x[i] = min(tries)
            else:
                step[i] /= 2
    assert plain_loss(rows, grades, w.tolist(), t.tolist(), penalty) <= best + 2e-3
    assert w[0] > w[1] > 0 > w[2] and abs(w[3]) < 0.3


def test_scores_equal_plain_ones(spark):
    model = toxicity.Model({toxicity.bucket("vile"): 2.0, toxicity.bucket("nasty"): 1.5, toxicity.bucket("kind"): -1.0, toxicity.bucket("harsh*"): 0.7}, (1.0, 2.0, 3.5), 0.5)
    texts = [None, "", "vile", "VILE nasty vile", "kind words", "harshest words", "harsh", "nasty " * 40_000, "x" * 200_000, "vile"]
    out = collected(toxicity.score(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), model))
    assert len(out) == len(texts)
    for r in out:
        words = set(re.findall(r"[^\W\d_]+", (texts[r["doc_id"]] or "").lower()))
        score = 2.0 * ("vile" in words) + 1.5 * ("nasty" in words) - 1.0 * ("kind" in words) + 0.7 * any(w.startswith("harsh") and len(w) > 5 for w in words)
        chances = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r["expected_severity"] == pytest.approx(sum(chances), abs=1e-6)
        speaks = "vile" in words or "nasty" in words or "harshest" in words
        assert r["toxic"] == (speaks and chances[0] >= 0.5)
        assert r["grade"] == (max(1, sum(c >= 0.5 for c in chances)) if r["toxic"] else 0)


def test_nothing_to_learn(spark, empty, docs):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert all(r["grade"] == 0 and not r["toxic"] for r in out)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).collect() == []


# -- repeated strings --------------------------------------------------------------------------------------------------


def plain_repeats(rows, span=50):
    first = {}
    for i, t in rows:
        b, k = (t or "").encode(), 2**63 - 1 if i is None else i
        for p in range(len(b) - span + 1):
            first[b[p : p + span]] = min(first.get(b[p : p + span], 2**63), k)
    out = []
    for i, t in rows:
        b, k = (t or "").encode(), 2**63 - 1 if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first[b[p : p + span]] < k:
                gone[p : p + span] = b"\1" * span
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((-1 if i is None else i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out)


def repeat_rows():
    rng = random.Random(11)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 130))) for _ in range(10)] + ["a" * 300, "ab" * 90, "é" * 60]
    rows = []
    for i in range(90):
        text = "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice([i, i, i, None, rng.randint(0, 90)]), text if rng.random() > 0.05 else None))
    return rows


@pytest.mark.parametrize("batch,piece,texts", [(10_000, 1 << 20, 4096), (3, 200, 4096), (10_000, 1 << 20, 0)])
def test_repeats(spark, monkeypatch, batch, piece, texts):
    """Also with tiny batches (runs of a rank over several), tiny pieces, and all anchors on the wide path."""
    rows = repeat_rows()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", (texts,))
    try:
        df = frame(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collected(suffix_dedup.remove_repeats(df)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_repeats(rows)


def test_units_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (0, 10, 49, 50, 51, 100, 149, 150, 500, 50)] + [b"a" * 400]
    seen = []
    for who, offsets, parts in suffix_dedup._joined(texts, 50):
        owner, begin, windows, _, _, _, _ = suffix_dedup.units_of(parts, suffix_dedup.Ranks(50), 50)
        lengths = np.array([len(p) for p in parts])
        base = np.cumsum(lengths) - lengths
        seen += [(who[o], offsets[o] + b - base[o] + i) for o, b, w in zip(owner, begin, windows) for i in range(w)]
    assert sorted(seen) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 49)]


def test_repeats_of_nothing(empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []
