"""hash60 over numpy arrays, for tasks that draw very many numbers from few rows."""

from __future__ import annotations

import math

import numpy as np

CHUNK = 24_576  # numbers hashed together: their six arrays stay in a core's cache

_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for t in turns]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(words: list, n: int, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 (RFC 1321) of n messages of one block; a word is one number for all
    messages or an array. The steps before the first array are taken once for all. `space` is uint32 of (6, n)
    at least, of which the result is a part."""
    mask, alike = 0xFFFFFFFF, next((i for i in range(16) if isinstance(words[i], np.ndarray)), 16)
    a, b, c, d = _START
    for i in range(alike):
        f = (((c ^ d) & b) ^ d) + a + _ADD[i] + words[i] & mask
        a, b, c, d = d, ((f << _TURNS[i] | f >> 32 - _TURNS[i]) + b) & mask, b, c
    f, g, *rest = (x[:n] for x in space)
    for x, v in zip(rest, (a, b, c, d)):
        x.fill(v)
    a, b, c, d = rest
    for i in range(alike, 64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[_WORD[i]]
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f), np.add(f, np.uint32(_ADD[i]), out=f)
        else:
            np.add(f, np.uint32((_ADD[i] + word) & mask), out=f)
        np.add(f, a, out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=g), np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, g, out=f), np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    np.add(a, np.uint32(_START[0]), out=a), np.add(b, np.uint32(_START[1]), out=b)
    return a, b


def _digit_words(before: int, first: int, last: int) -> tuple[np.ndarray, int]:
    """The message words that hold the digits of first..last - 1 (all of the same number of digits) after
    `before` other characters, and the number of the first such word."""
    digits = len(str(first))
    block = np.zeros((last - first, 64), np.uint8)
    rest = np.arange(first, last, dtype=np.int64)
    for place in range(before + digits - 1, before - 1, -1):
        tens = rest // 10
        block[:, place] = rest - tens * 10 + 48
        rest = tens
    start, stop = before // 4, (before + digits - 1) // 4
    return block.view("<u4")[:, start : stop + 1].astype(np.uint32).T.copy(), start


class Hash60:
    """hash60(*parts, k) for k in first..last - 1, whatever the parts: the digits of k are laid out once for
    all parts of one length."""

    def __init__(self, first: int, last: int):
        self.runs = []  # stretches of equal numbers of digits, cut into chunks
        lo = first
        while lo < last:
            hi = min(last, 10 ** len(str(lo)), lo + CHUNK)
            self.runs.append((lo, hi))
            lo = hi
        self.first, self.n, self.kept = first, last - first, {}
        self.space = np.empty((6, min(CHUNK, max(0, self.n))), np.uint32)

    def __call__(self, *parts) -> np.ndarray:
        prefix = "".join(f"{p}:" for p in parts).encode()
        out = np.empty(self.n, np.int64)
        for lo, hi in self.runs:
            length = len(prefix) + len(str(lo))
            if length > 55:
                raise ValueError("the parts are too long for one block")
            key = (len(prefix), lo)
            if key not in self.kept:
                self.kept[key] = _digit_words(len(prefix), lo, hi)
            own, start = self.kept[key]
            fixed = np.frombuffer((prefix + b"\0" * 64)[:64], "<u4").copy()
            end = np.zeros(64, np.uint8)
            end[length] = 0x80
            fixed |= end.view("<u4")
            fixed[14] = length * 8
            words = [int(w) for w in fixed]
            for j, w in enumerate(own, start):
                words[j] = w | np.uint32(words[j])
            a, b = _first_words(words, hi - lo, self.space)
            out[lo - self.first : hi - self.first] = ((a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> np.uint32(4))).astype(np.int64)
        return out
