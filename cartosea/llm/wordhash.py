"""Vectorised hashes of words and word windows.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; a window's hash is a polynomial over its words'
hashes modulo 2**64, taken from running sums, so every window of a length costs a few array operations.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15 | 1, (0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return tuple(p[:n] for p in _POWERS[base])


class Words:
    """The words of some texts: start and end bytes in buf, doc index and hash of each; first[i] is text i's first word."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        buf = b" ".join(texts) + b" "
        self.raw = buf
        self.buf = np.frombuffer(buf, np.uint8)
        arr = self.buf
        if lower:
            arr = arr + ((arr >= 65) & (arr <= 90)).astype(np.uint8) * np.uint8(32)
        space = _IS_SPACE[arr]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.begin = begin  # first byte of each text, and the end
        self.first = np.searchsorted(self.start, begin)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        up, down = powers(BYTE_BASE, len(arr) + 1)
        run = np.zeros(len(arr) + 1, _U)
        np.cumsum((arr.astype(_U) + _U(1)) * up[:-1], out=run[1:])
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start] + (self.end - self.start).astype(_U))

    def windows(self, size: int, which: int = 0) -> np.ndarray:
        """Hash of the size words from each word on; right only where inside() holds."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, _U)
        up, down = powers(WORD_BASES[which], n + 1)
        run = np.zeros(n + 1, _U)
        np.cumsum(self.hash * up[:n], out=run[1:])
        return mix((run[size:] - run[:-size]) * down[: n - size + 1])

    def inside(self, size: int) -> np.ndarray:
        """Whether the window from each word on (len - size + 1 of them) stays in one text."""
        n = len(self.hash)
        return self.doc[: n - size + 1] == self.doc[size - 1 :] if n >= size else np.zeros(0, bool)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a window of size words that starts at one of starts."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1) if len(np.unique(starts)) < len(starts) else d.__setitem__(starts, 1)
    e = np.zeros(n + 1, np.int64)
    np.add.at(e, np.minimum(np.asarray(starts) + size, n), 1)
    return np.cumsum(d - e)[:n] > 0


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each run of width values."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, value, have = np.arange(len(x)), x, 1
    while have < width:
        step = min(have, width - have)
        left, right = value[:-step], value[step:]
        take = right < left
        best = np.where(take, best[step:], best[:-step])
        value = np.where(take, right, left)
        have += step
    return best[:n]
