"""Byte-pair encoding of whole texts, however long their runs of white space."""

from __future__ import annotations

import base64
import re

import numpy as np

#: A pattern library gives up on runs much longer than this one, so these are cut out beforehand, where the pattern would cut.
WIDE_SPACE = re.compile(r"\s{4097,}")


class BytePairs:
    """A vocabulary file of ranked byte strings; ids are the ranks."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; no string in it is special.

        The pattern takes a run of white space up to its last character for one piece, and what follows begins with
        that character; at the text's end the whole run is one piece.
        """
        if len(text) < 4097:
            return self.coder.encode_to_numpy(text, disallowed_special=())
        parts, start = [], 0
        for run in WIDE_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            if run.start() > start:
                parts.append(self.coder.encode_to_numpy(text[start : run.start()], disallowed_special=()))
            parts.append(np.array(self.coder._encode_single_piece(text[run.start() : end]), np.uint32))
            start = end
        parts.append(self.coder.encode_to_numpy(text[start:], disallowed_special=()))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]
