"""Vectorised hashing of the words of many texts at once, in numpy.

Words are runs of `[^\\x20\\x09-\\x0D]`. A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix
sums and then mixed; the hash of any run of words comes from prefix sums over word hashes in the same way. Words can be
written that share a hash, so it deals work and picks features, and never decides that two words are equal.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multipliers, so that they have inverses modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        steps = np.full(size, base, _U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(steps)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _spans(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, independent of the place."""
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * powers(base, len(values)), out=sums[1:])
        return (sums[end] - sums[start]) * powers(inverse, len(values) + 1)[start]


class Words:
    """The words of a list of texts: byte range, text number and hash of each; `first[d]:first[d + 1]` are text d's."""

    def __init__(self, texts: list[bytes | None], hashes: bool = True):
        lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.data = b"\n".join(t or b"" for t in texts)
        raw = np.frombuffer(self.data, np.uint8)
        ends_of_text = np.cumsum(lengths + 1)
        if len(raw):
            space = _SPACE[raw]
            word = ~space
            begin = word.copy()
            begin[1:] &= space[:-1]
            end = word.copy()
            end[:-1] &= space[1:]
            self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends_of_text)]).astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if hashes:
            with np.errstate(over="ignore"):
                self.hash = mix(_spans(raw.astype(_U) + _U(1), BYTE_BASE, self.start, self.end) + (self.end - self.start).astype(_U))

    def __len__(self) -> int:
        return len(self.start)

    def runs(self, start: np.ndarray, end: np.ndarray, base: int = WORD_BASE) -> np.ndarray:
        """Hash of the words start..end-1 for each pair."""
        with np.errstate(over="ignore"):
            return mix(_spans(self.hash, base, start, end) + (end - start).astype(_U))

    def bytes_of(self, start: int, end: int) -> bytes:
        """The words start..end-1 joined by one space."""
        return b" ".join(self.data[self.start[start] : self.end[end - 1]].split()) if end > start else b""
