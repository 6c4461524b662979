"""MD5 of many short messages side by side: numbers drawn from keys, the same in any engine."""

from __future__ import annotations

import numpy as np

#: Constants, turns and word order of the 64 steps.
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORDS = [[i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16][i // 16] for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_leading(heads: np.ndarray, tails: list[bytes]) -> np.ndarray:
    """The first 32 bits of the MD5 of every head with every tail after it (tails x heads, uint32).

    heads: uint8 (heads x length), all of one length; a message has at most 55 bytes. Words that are the same for all heads stay plain numbers.
    """
    n, length = heads.shape
    if length + max(map(len, tails)) > 55:
        raise ValueError("messages of more than 55 bytes")
    fixed = length // 4  # the words before hold bytes of heads only
    padded = np.zeros((n, 4 * (fixed + 1)), np.uint8)
    padded[:, :length] = heads
    own = np.ascontiguousarray(padded.view("<u4").T.astype(np.uint32))
    out = np.empty((len(tails), n), np.uint32)
    rest = np.stack([np.frombuffer((bytes(length) + t + b"\x80").ljust(56, b"\0") + (8 * (length + len(t))).to_bytes(8, "little"), "<u4") for t in tails]).astype(np.uint32)
    wide = min(n, 16384) or 1
    some = max(1, 16384 // wide)  # tails side by side: long rows, few calls
    for at in range(0, n, wide):
        for k in range(0, len(tails), some):
            out[k : k + some, at : at + wide] = _first_word(own[:, at : at + wide], rest[k : k + some])
    return out


def _first_word(own: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The digests' first words (tails x heads); a message is the sum of its head's words (words x heads) and its tail's (tails x 16)."""
    shape = len(rest), own.shape[1]
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    same = (rest == rest[0]).all(0)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        word = _WORDS[i]
        f += a
        f += np.uint32((_SINES[i] + int(rest[0, word])) & 0xFFFFFFFF) if same[word] else rest[:, word, None] + np.uint32(_SINES[i])
        if word < len(own):
            f += own[word]
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        f >>= np.uint32(32 - turn)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    return a.byteswap()
