"""Hashes of substrings and words of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

from shelfwise.llm.common import SPACES

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_BASES = (BASE, pow(BASE, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LEAST = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?&$|#*<>%()\"'"]] = True


def _power(which: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base, or of its inverse, modulo 2^64."""
    if _powers[which].size < n:
        steps = np.full(max(n, _LEAST), _BASES[which], np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of the 64-bit values over all others; works in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


class Grams:
    """Hashes of any substring of ``buffer`` from running sums, as if each substring stood alone."""

    def __init__(self, buffer: np.ndarray):
        self.sums = np.zeros(buffer.size + 1, np.uint64)
        np.cumsum(_BYTE[buffer] * _power(0, buffer.size), out=self.sums[1:])

    def of(self, starts, ends) -> np.ndarray:
        x = self.sums[ends] - self.sums[starts]
        x *= _power(1, self.sums.size)[starts]
        return mix(x)


class Words:
    """All words of some texts (UTF-8 bytes, A-Z taken as lower case), in order; ``text`` is the index of each one's text.

    ``bare`` leaves marks at the end of a word out of it, unless nothing would be left.
    """

    def __init__(self, raw: list[bytes], bare: bool = False):
        joined = b" ".join(raw).lower() + b" "
        buffer = np.frombuffer(joined, np.uint8)
        self.buffer = buffer
        space = _SPACE[buffer]
        edges = np.diff(space.astype(np.int8), prepend=1)
        self.starts, self.ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        sizes = np.array([len(x) + 1 for x in raw], np.int64)
        self.text = np.searchsorted(np.cumsum(sizes), self.starts, "right")
        if bare:
            for _ in range(4):
                last = np.maximum(self.ends - 1, self.starts)
                self.ends = self.ends - (_MARK[buffer[last]] & (last > self.starts))
        self.grams = Grams(buffer)
        self.hashes = self.grams.of(self.starts, self.ends)

    def prefix(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of every word."""
        return self.grams.of(self.starts, np.minimum(self.starts + size, self.ends))
