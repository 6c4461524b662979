"""SentencePiece BPE encoding and decoding by a prefix table.

For merge-type vocabularies the encoding of every prefix ends in one unique token, and a token sequence is an encoding
exactly if each neighbouring pair is: merging the pair's joined text gives back the pair. So the table holds, for each
prefix of a chunk, the last token: of the tokens that end there (found by an Aho-Corasick automaton over the pieces)
the one that is compatible with the last token of the prefix before it. The ids are then read off backwards. Time is
linear in the text, with no priority queue. Chunks end where no piece can span: before white space that follows other
characters, at line feeds and, if the vocabulary allows it, before ASCII signs that follow a letter; this is checked against the
pieces when the model is loaded.

Defined results: a null text is the empty text, whose ids are begin and end only; characters without a piece become
the byte pieces of their UTF-8; texts of any length are encoded whole; equal rows get equal results; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEPT, map_slices, pick, texts_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Most new (and most older) chunks that a worker remembers, and the longest of them: texts without spaces are one chunk.
REMEMBERED = 150_000
LONGEST = 64
#: For character classes: Latin letters, and ASCII signs, digits and controls; many vocabularies hold no piece in which
#: one of the second follows one of the first.
LETTERS = r"A-Za-zÀ-ÖØ-öø-ɏ"
SIGNS = r"!-@\[-`{-~\x00-\x09\x0b-\x1f\x7f"


def public_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """A dict that computes what it lacks. It holds at most `most` new entries and as many older ones; when the new are
    full they become the older, so what is used often stays and memory stays bounded. Texts of more than `longest`
    characters are computed each time."""

    def __init__(self, function, most: int, longest: int | None = None):
        super().__init__()
        self.function, self.most, self.longest, self.older = function, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.function(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.function(key)
        self[key] = out
        return out


class Codec:
    """Encoder and decoder for one merge-type SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback and no text normalisation are supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.bos = next(i for i, p in enumerate(self.pieces) if p == "<s>")
        self.eos = next(i for i, p in enumerate(self.pieces) if p == "</s>")
        self.unk = self.kinds.index(kinds.UNKNOWN)
        self.normal = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == kinds.NORMAL}
        self.byte_ids = [0] * 256
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == kinds.BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        for p in self.normal:
            if "\n" in p or SPACE in p.lstrip(SPACE):
                raise ValueError("a piece spans what this encoder takes for the end of a chunk")
        letter, sign = re.compile(f"[{LETTERS}]"), re.compile(f"[{SIGNS}]")
        parted = not any(letter.match(a) and sign.match(b) for p in self.normal for a, b in zip(p, p[1:]))
        ending = rf"(?:[{LETTERS}]++(?![{SIGNS}])[^{LETTERS} \n]++)*+[{LETTERS}]*+" if parted else r"[^ \n]*+"
        self.chunks = re.compile(rf"\n| *+[^{LETTERS} \n]*+{ending}")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.normal.items():
            if self._merge(p) == [i]:  # a piece that merging never makes is in no encoding
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.many, self.lengths = len(self.pieces), [len(p) for p in self.pieces]
        self.fits = Memo(lambda pair: self._fit(*divmod(pair, self.many)), REMEMBERED)
        self.halves = Memo(self._halves, REMEMBERED)
        self.chunk_ids = Memo(self._chunk_bytes, REMEMBERED, LONGEST)
        self.piece_bytes = [b""] * len(self.pieces)
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == kinds.BYTE:
                self.piece_bytes[i] = bytes([int(p[3:5], 16)])
            elif self.kinds[i] == kinds.UNKNOWN:
                self.piece_bytes[i] = " ⁇ ".encode()
            elif self.kinds[i] != kinds.CONTROL:
                self.piece_bytes[i] = p.replace(SPACE, " ").encode()
        self.is_byte = np.array([k == kinds.BYTE for k in self.kinds])
        self.is_control = np.array([k == kinds.CONTROL for k in self.kinds])

    def _merge(self, text: str, stop: int = 1) -> list[int]:
        """Merges by the definition, for the texts of one or two pieces: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            if len(parts) <= stop:
                return [self.normal.get(p, -1) for p in parts]
            best = None
            for i in range(len(parts) - 1):
                j = self.normal.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best[0]):
                    best = (self.scores[j], i)
            if best is None:
                return [self.normal.get(p, -1) for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two pieces whose merge made a token last; none for a single character."""
        parts = self._merge(self.pieces[token], stop=2)
        return tuple(parts) if len(parts) == 2 and -1 not in parts else None

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives back the two.

        The merges that made the pieces are undone from the worst score on, only along the border between them; if
        at some time the pieces at the border had a merge that was due before the one undone last, it would have
        joined them. Runs of spaces, whose pieces all have one score, are merged by the definition instead.
        """
        scores, pieces, normal = self.scores, self.pieces, self.normal
        if pieces[left][-1] == SPACE and pieces[right][0] == SPACE:
            return self._merge(pieces[left] + pieces[right]) == [left, right]
        due, from_left = float("-inf"), False
        while True:
            joined = normal.get(pieces[left] + pieces[right])
            # among equal scores the left one is first: a merge at the border comes after an equal one in the left piece
            if joined is not None and (scores[joined] > due or scores[joined] == due and not from_left):
                return False
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and scores[left] < scores[right]:
                due, from_left, left = scores[left], True, a[1]
            else:
                due, from_left, right = scores[right], False, b[0]

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of one chunk by its prefix table; a character without a piece stands in it as -1 and ends what it follows."""
        last, lengths, fits, many = [-1] * (len(text) + 1), self.lengths, self.fits, self.many
        for end, token in self.automaton.iter(text):  # by their ends, and the longest first
            end += 1
            if last[end] < 0:
                before = end - lengths[token]
                if before == 0 or (previous := last[before]) < 0 or fits[previous * many + token]:
                    last[end] = token
        out: list[int] = []
        i = len(text)
        while i:
            token = last[i]
            if token >= 0:
                out.append(token)
                i -= lengths[token]
            else:
                i -= 1
                if text[i] in self.normal:
                    raise AssertionError(f"no token fits the end of a prefix of {text!r}")
                out += [self.byte_ids[b] for b in reversed(text[i].encode())]
        return out[::-1]

    def _chunk_bytes(self, chunk: str) -> bytes:
        ids = array("I", self.encode_chunk(chunk.replace(" ", SPACE)))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text, without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        return b"".join(map(self.chunk_ids.__getitem__, self.chunks.findall(" " + text if self.prefix else text)))

    def encode(self, text: str, ends: bool = True) -> list[int]:
        ids = np.frombuffer(self.encode_bytes(text), "<u4").tolist()
        return [self.bos, *ids, self.eos] if ends else ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces vanish, one leading space of the first other piece goes, runs of byte pieces are read as UTF-8."""
        table, control = self.piece_bytes, (self.bos, self.eos)
        ids = ids[next((i for i, x in enumerate(ids) if x not in control), len(ids)) :]
        while ids and ids[-1] in control:
            ids = ids[:-1]
        if self.bos in ids or self.eos in ids:  # they part byte runs
            return self._decode_damaged(ids)
        raw = b"".join(map(table.__getitem__, ids))
        if self.prefix:
            first = ids[0] if ids else None
            if first is not None and self.kinds[first] == 1 and table[first][:1] == b" ":
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_damaged(ids)

    def _decode_damaged(self, ids: list[int]) -> str:
        """Byte runs that are not UTF-8: each byte that starts no whole character becomes U+FFFD."""
        out, run, first = [], bytearray(), True

        def flush() -> None:
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + n]).decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i in ids:
            if self.is_control[i]:
                flush()
                continue
            if self.is_byte[i]:
                run += self.piece_bytes[i]
            else:
                flush()
                piece = self.piece_bytes[i].decode()
                out.append(piece[1:] if first and self.prefix and self.kinds[i] == 1 and piece[:1] == " " else piece)
            first = False
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


KEPT["codec"] = codec.cache_clear


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; with_ids adds ids array<int>, with_text decoded string."""
    path = path or public_path()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        begin, end = (np.array([x], "<u4").tobytes() for x in (c.bos, c.eos))
        counts, hashes, decoded, ids, texts = [], [], [], [], []
        for text in texts_of(part, "text"):
            raw = begin + c.encode_bytes(text) + end
            found = np.frombuffer(raw, "<u4").tolist()
            back = c.decode(found)
            counts.append(len(found))
            hashes.append(hashlib.sha256(raw).hexdigest())
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
            ids.append(found if with_ids else None)
            texts.append(back if with_text else None)
        columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        if with_text:
            columns.append(pa.array(texts, pa.string()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(columns, names)

    slim = pick(docs, doc_id=id_col, text=F.col(text_col).cast("string"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return map_slices(slim, "text", run, schema, uses="codec")


def op4_piece_codec(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
