"""Personal data by weak supervision.

Base spans are the strict patterns of the contract (email, ip, card, phone). Around them the method looks at wider
candidates: phone numbers without a plus, card-like numbers, obfuscated addresses, keys after a naming word, national
numbers, bank accounts, hardware addresses and names. Labelers vote on each candidate (+1, -1 or none): the strict
form (regex), a gazetteer, the words before it (context), a checksum, the shape of its neighbours, and its variety of
characters. Expectation-maximisation estimates each labeler's reliability and each kind's prior from the counts of
vote patterns over all documents, which gives every pattern a soft label. A logistic span classifier is then fitted to
these labels on at most `most_spans` candidates (those with the least hashes) and decides on the spans to add. It sees
the votes and the kind, and what no labeler looks at: the span's length, its share of digits, the shape of its
characters and the words around it. Vote patterns are few by construction (kinds times 3 to the labelers), so their counts and
the bounded sample are all that reaches the driver. Added spans never overlap base spans or each other.

Defined results: a null text is empty and has no spans; texts are read whole, in linear time for any input; repeated
rows get equal results; an empty table, or one without candidates, adds nothing; candidates with equal features are
decided alike; other columns are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_slices, pick, texts_of
from tessera.runtime import stage

BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches in linear time: one can only start where a run of digits does, and takes whole runs.
IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")

#: Words that announce personal data, by kind.
CONTEXT = {
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono", "whatsapp"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"),
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "auth", "bearer", "credential"),
    "ssn": ("ssn", "social security", "national id", "tax id"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "mac": ("mac", "hardware", "device", "ethernet"),
    "name": ("name is", "named", "signed", "contact", "regards", "heiße", "appelle", "llamo", "mr", "mrs", "ms", "dr", "herr", "frau", "señor", "señora"),
}
#: A small gazetteer of given names.
GIVEN_NAMES = frozenset(
    "Adam Ahmed Alexander Alice Amelia Ana Andrea Andrew Anna Anne Antonio Barbara Ben Brian Carlos Carmen Caroline Catherine Charles Charlotte Christian "
    "Christine Claire Daniel David Diego Elena Elizabeth Emily Emma Eric Eva Felix Fernando Francesca Frank George Hannah Hans Helen Henry Ines Isabel Jack Jacob "
    "James Jan Jane Javier Jean Jennifer Jessica Johann John Jonas Jose Joseph Juan Julia Julie Karl Katharina Laura Lea Leon Linda Lisa Louis Lucas Lucia Luis "
    "Manuel Maria Marie Mark Martin Mary Matthew Max Maximilian Michael Miguel Mohamed Nicolas Nina Olivia Pablo Patricia Paul Pedro Peter Philipp Pierre Rachel "
    "Rebecca Richard Robert Rosa Samuel Sara Sarah Sebastian Simon Sofia Sophie Stefan Stephen Susan Thomas Tobias Victoria William".split()
)
#: For the gazetteer's other votes.
MAIL_ENDINGS = frozenset("com org net edu gov io de fr es uk eu info".split())
IBAN_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())

PHONE_LIKE = re.compile(r"(?<![0-9.+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")
CARD_LIKE = re.compile(r"(?<![0-9.+-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9.-])")
MAIL_LIKE = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]? ?(?:at|@) ?[\])]? ?[A-Za-z0-9-]{1,63}(?: ?[\[(]? ?(?:dot|\.) ?[\])]? ?[A-Za-z0-9-]{2,63}){1,4}")
SECRET_LIKE = re.compile(r"(?i:token|secret|api[_ -]?key|access[_ -]?key|password|passwd|pwd|bearer)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{8,}+)")
AWS_LIKE = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])")
SSN_LIKE = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN_LIKE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
MAC_LIKE = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
NAME_LIKE = re.compile(r"(?:[Mm]y name is|[Ss]igned by|[Cc]ontact|[Rr]egards,|[Ii]ch heiße|m'appelle|[Mm]e llamo|\bMr\.|\bMrs\.|\bMs\.|\bDr\.|\bHerr|\bFrau|\bSeñora?) ((?:[A-ZÀ-Þ][a-zß-ÿ]{1,20})(?: [A-ZÀ-Þ][a-zß-ÿ]{1,20}){0,2})")
NAME_SIGNS = ("name is", "igned by", "ontact ", "egards, ", "heiße ", "appelle ", "llamo ", "Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Herr ", "Frau ", "Señor")
#: Buckets of the classifier's features, and most candidates that it is fitted on.
BUCKETS = 1 << 12
MOST_SPANS = 20_000
LETTERS = re.compile(r"[^\W\d_]+")
LABELERS = ("regex", "gazetteer", "context", "checksum", "neighbours", "variety")
KINDS = ("email", "card", "phone", "secret", "ssn", "iban", "mac", "name")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, looked for only around at signs: a match starts where the run of local characters before one does."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m.span()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end and kind of the strict matches, by start and then kind."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP_RUNS.finditer(text):
            if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return [(s, e, BASE_KINDS[k]) for s, k, e in out]


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


def _iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    if "=" in text or ":" in text:
        for m in SECRET_LIKE.finditer(text):
            yield "secret", *m.span(1)
        for m in MAC_LIKE.finditer(text) if text.count(":") > 4 else ():
            yield "mac", *m.span()
    if DIGIT.search(text):
        for kind, pattern in (("card", CARD_LIKE), ("phone", PHONE_LIKE), ("ssn", SSN_LIKE), ("iban", IBAN_LIKE)):
            for m in pattern.finditer(text):
                yield kind, *m.span()
        if "AKIA" in text or "gh" in text and "_" in text or "sk-" in text:
            for m in AWS_LIKE.finditer(text):
                yield "secret", *m.span()
    if "@" in text or "dot" in text and re.search(r"[\[(] ?at ?[\])]| at [A-Za-z0-9-]+ dot ", text):
        for m in re.finditer(r"@| at |[\[(] ?at ?[\])]", text):
            start = text.rfind(" ", max(0, m.start() - 67), max(0, m.start() - 1)) + 1
            if found := MAIL_LIKE.match(text, max(start, m.start() - 66)):
                if found.end() > m.end():
                    yield "email", *found.span()
    if any(map(text.__contains__, NAME_SIGNS)):
        for m in NAME_LIKE.finditer(text):
            yield "name", *m.span(1)


def votes(text: str, kind: str, start: int, end: int) -> str:
    """One sign for each labeler."""
    span = text[start:end]
    before = text[max(0, start - 40) : start].lower()
    digits = NOT_DIGIT.sub("", span)
    compact = re.sub(r"\s", "", span)
    context = any(w in before for w in CONTEXT[kind])
    other = any(w in before for k, ws in CONTEXT.items() if k != kind for w in ws)
    left, right = text[start - 1 : start], text[end : end + 1]
    isolated = not (left.isalnum() or right.isalnum())
    variety = len(set(compact)) / max(1, min(len(compact), 16))
    regex = gazetteer = checksum = "0"
    if kind == "email":
        ending = re.split(r"[ .\])]", span)[-1].lower()
        regex = _vote(bool(re.search(r"[\[(] ?at|@| at ", span)) and bool(re.search(r"dot|\.", span)))
        gazetteer = _vote(ending in MAIL_ENDINGS, True)
        checksum = _vote(bool(re.search(r"[\[(] ?(at|dot)|@| at \S+ dot ", span)), True)
    elif kind == "card":
        regex, gazetteer, checksum = _vote(digits[:1] in "3456", True), _vote(False, digits[:1] in "01789"), _vote(luhn(digits), True)
    elif kind == "phone":
        regex = _vote(span.startswith("(") or len(digits) in (10, 11), len(digits) < 9)
        gazetteer = _vote("555" in digits)
    elif kind == "secret":
        regex = _vote(bool(re.fullmatch(r"[A-Za-z0-9_\-/+=.]{16,}", span)), len(span) < 12)
        gazetteer = _vote(bool(re.fullmatch(r"[0-9a-fA-F]{16,}|AKIA\w+|gh\w_\w+|sk-\w+", span)), span.isalpha())
    elif kind == "ssn":
        regex, checksum = "+", _vote(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00", True)
    elif kind == "iban":
        regex, gazetteer, checksum = _vote(15 <= len(compact) <= 34, True), _vote(span[:2] in IBAN_COUNTRIES, True), _vote(_iban_ok(span), True)
    elif kind == "mac":
        regex, gazetteer = "+", _vote(False, span in ("00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff"))
    else:
        parts = span.split()
        regex, gazetteer = _vote(len(parts) > 1), _vote(parts[0] in GIVEN_NAMES, True)
    return regex + gazetteer + _vote(context, other) + checksum + _vote(isolated, not isolated) + _vote(variety > 0.35, variety < 0.2)


def span_features(text: str, kind: str, start: int, end: int, vote: str) -> list[int]:
    """The buckets (0 stands for all spans) of a candidate: kind, votes, length, digits, shape, and the words around it."""
    span = text[start:end]
    shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "9", span)))[:16]
    names = [kind, *[f"{name}{v}" for name, v in zip(LABELERS, vote) if v != "0"], f"{kind} length {len(span).bit_length()}", f"{kind} digits {4 * len(NOT_DIGIT.sub('', span)) // max(1, len(span))}", f"{kind} shape {shape}"]
    names += [f"{kind} before {w}" for w in LETTERS.findall(text[max(0, start - 40) : start].lower())[-2:]]
    names += [f"{kind} after {w}" for w in LETTERS.findall(text[end : end + 24].lower())[:1]]
    return sorted({0, *[1 + zlib.crc32(n.encode()) % (BUCKETS - 1) for n in names]})


def candidate_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[str, int, int, str, list[int]]]:
    """kind, start, end, votes and features of what lies apart from the base spans and earlier candidates; the longest of those that start together."""
    found = sorted(set(_candidates(text)), key=lambda x: (x[1], -x[2], x[0]))
    out, taken = [], sorted((s, e) for s, e, _ in base)
    free, at, reach = 0, 0, 0
    for kind, start, end in found:
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if start >= free and start >= reach:
            vote = votes(text, kind, start, end)
            out.append((kind, start, end, vote, span_features(text, kind, start, end, vote)))
            free = end
    return out


def fit_reliabilities(counts: dict[tuple[str, str], int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """Each kind's prior and the labelers' chances of (-, 0, +) by class, from counts of (kind, votes).

    Expectation-maximisation over the patterns; all starts slightly in favour of honest labelers, and counts are
    smoothed so that no chance becomes 0.
    """
    signs = "-0+"
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    seen = np.array([[signs.index(v) for v in k[1]] for k in keys]).reshape(len(keys), len(LABELERS))
    kinds = sorted({k[0] for k in keys})
    of = np.array([kinds.index(k[0]) for k in keys], int)
    prior = np.full(len(kinds), 0.5)
    chance = np.tile(np.array([[0.45, 0.35, 0.2], [0.2, 0.35, 0.45]]), (len(LABELERS), 1, 1))
    for _ in range(rounds):
        each = np.log(np.stack([1 - prior[of], prior[of]], 1))
        for j in range(len(LABELERS)):
            each += np.log(chance[j][:, seen[:, j]].T)
        p = np.exp(each - each.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = p * n[:, None]
        before = prior.copy()
        prior = np.array([(weight[of == k, 1].sum() + 1) / (n[of == k].sum() + 2) for k in range(len(kinds))])
        for j in range(len(LABELERS)):
            for v in range(3):
                chance[j, :, v] = (weight[seen[:, j] == v].sum(0) + np.array([[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]])[:, v])
            chance[j] /= chance[j].sum(1, keepdims=True)
        if np.abs(prior - before).max() < 1e-9:
            break
    return dict(zip(kinds, prior.tolist())), chance


def soft_labels(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """The chance that spans with a pattern are personal data, by the estimated priors and reliabilities."""
    if not counts:
        return {}
    prior, chance = fit_reliabilities(counts)
    out = {}
    for kind, vote in counts:
        a = np.log([1 - prior[kind], prior[kind]])
        for j, v in enumerate(vote):
            a = a + np.log(chance[j][:, "-0+".index(v)])
        out[kind, vote] = float(1 / (1 + np.exp(a[0] - a[1])))
    return out


def fit_classifier(features: list[list[int]], labels: list[float], decay: float = 1.0, steps: int = 2000) -> np.ndarray:
    """Weights of a logistic regression with a ridge penalty on soft labels, by accelerated gradient steps with restarts."""
    w = np.zeros(BUCKETS)
    if not features:
        return w
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.concatenate([np.asarray(f, np.int64) for f in features])
    y = np.asarray(labels)

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, v[col], len(y))

    v, norm = np.ones(BUCKETS), 1.0
    for _ in range(30):
        v = np.bincount(col, times(v)[row], BUCKETS)
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1 / (0.25 * 1.05 * norm + decay)
    at, momentum = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(at), -50, 50)))
        slope = np.bincount(col, (p - y)[row], BUCKETS) + decay * at
        new = at - step * slope
        if np.abs(slope).max() < 1e-6:
            return new
        if float(slope @ (new - w)) > 0:  # uphill: start anew from here
            momentum = 1.0
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at, w, momentum = new + (momentum - 1) / faster * (new - w), new, faster
    return w


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict | None = None, text_as: str | None = None) -> DataFrame:
    """base (array of start, end, kind) and more (array of kind, start, end, votes, features) of every row; `keep` adds columns of docs, text_as the text."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    wide = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        base, more = [], []
        for text in texts_of(part, "text"):
            spans = base_spans(text)
            base.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
            more.append([{"start": s, "end": e, "kind": k, "votes": v, "features": f} for k, s, e, v, f in candidate_spans(text, spans)])
        names = [x for x in part.schema.names if x != "text"]
        whole = [part.column("text")] if text_as else []
        return pa.RecordBatch.from_arrays([*[part.column(x) for x in names], *whole, pa.array(base, pa.list_(span)), pa.array(more, pa.list_(wide))], [*names, *[text_as] * len(whole), "base", "more"])

    slim = pick(docs, doc_id=id_col, text=F.col(text_col).cast("string"), **(keep or {}))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    fields += f", `{text_as}` string" if text_as else ""
    return map_slices(slim, "text", run, f"{fields}, base array<struct<start:long,end:long,kind:string>>, more array<struct<start:long,end:long,kind:string,votes:string,features:array<int>>>")


def train(found: DataFrame, most_spans: int = MOST_SPANS) -> np.ndarray:
    """The span classifier's weights from staged rows of find_candidates: votes of all, features of at most `most_spans` candidates."""
    each = found.select("doc_id", F.explode("more").alias("c"))
    patterns = each.groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    labels = soft_labels({(r["kind"], r["votes"]): r["n"] for r in patterns.collect()})  # at most kinds x 3 ** labelers rows
    if not labels:
        return fit_classifier([], [])
    place = F.xxhash64("doc_id", "c.start", "c.kind")
    some = each.orderBy(place, "doc_id", "c.start", "c.kind", "c.votes", "c.features").limit(most_spans).select("c.kind", "c.votes", "c.features").collect()
    return fit_classifier([r["features"] for r in some], [labels[r["kind"], r["votes"]] for r in some])


def find_personal_data(docs: DataFrame, threshold: float = 0.5, most_spans: int = MOST_SPANS, id_col: str = "doc_id", text_col: str = "text", keep: dict | None = None, text_as: str | None = None) -> DataFrame:
    """Every row's base spans and spans (base and added, by start), as arrays of (start, end, kind)."""
    kept = [*(keep or {}), *([text_as] if text_as else [])]
    found = stage(find_candidates(docs, id_col, text_col, keep, text_as), "pii-candidates")
    weights = F.lit(train(found, most_spans))
    least = float(np.log(threshold / (1 - threshold)))
    chosen = F.filter("more", lambda c: F.aggregate(c["features"], F.lit(0.0), lambda sum_, x: sum_ + F.get(weights, x)) >= least)
    added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return found.select("doc_id", *kept, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_personal_data's rows."""

    def count(kind: str):
        return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def line(column: str):
        order = F.array(*[F.lit(k) for k in (*BASE_KINDS, *[k for k in KINDS if k not in BASE_KINDS])])
        keyed = F.array_sort(F.transform(column, lambda c: F.struct(c["start"].alias("start"), F.array_position(order, c["kind"]).alias("at"), c["end"].alias("end"), c["kind"].alias("kind"))))
        return F.array_join(F.transform(keyed, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")

    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span (overlapping ones together) replaced by its first kind in brackets."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs with every found span of their texts replaced; n_chars, if there, follows the new text."""
    kept = {f"_keep_{c}": docs[c] for c in docs.columns if c != "text"}
    names = [*kept, "_keep_text"]
    found = find_personal_data(docs, keep=kept, text_as="_keep_text").select("spans", *names)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [redact(t, [(x["start"], x["end"], x["kind"]) for x in spans]) if spans else t for t, spans in zip(part.column("_keep_text").to_pylist(), part.column("spans").to_pylist())]
        columns = [pa.array(texts, pa.string()) if c == "_keep_text" else part.column(c) for c in names]
        return pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name in names)
    out = map_slices(found, "_keep_text", run, fields).select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_weak_supervision(spark, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def brute_digest(text: str | None) -> tuple[Counter, str]:
    """The base contract as plainly as it is stated, for tests."""
    text = text or ""
    out = []
    for at, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if (at == 1 and any(int(p) > 255 for p in m.group().split("."))) or (at == 2 and not (12 <= len(digits) <= 19 and luhn(digits))) or (at == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), at, m.end()))
    out.sort()
    line = ",".join(f"{BASE_KINDS[k]}:{s}:{e}" for s, k, e in out)
    return Counter(BASE_KINDS[k] for _, k, _ in out), hashlib.sha256(line.encode()).hexdigest()
