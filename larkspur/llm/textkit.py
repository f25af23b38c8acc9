"""Words and word hashes of whole texts, vectorised over the UTF-8 bytes of a block of texts."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20  # bytes of text handled at once; a longer text is a block of its own
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)
_FOLD = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        more = np.full(max(n, BLOCK + 2), _BASE, np.uint64)
        more[0] = 1
        made = np.multiply.accumulate(more)
        if n > 4 * BLOCK:
            return made
        _POW = made
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def blocks(texts: list[str | None]):
    """Yield (first, encoded texts) with about BLOCK bytes in each; null is empty."""
    first, have, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if have and size + len(b) > BLOCK:
            yield first, have
            first, have, size = i, [], 0
        have.append(b)
        size += len(b) + 1
    if have:
        yield first, have


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts: byte spans in buf, the text of each, and for each text its slice of words."""

    def __init__(self, encoded: list[bytes], lower: bool):
        self.buf = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        self.text_end = np.cumsum(sizes)
        self.text_start = self.text_end - sizes
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.searchsorted(self.start, self.text_end)

    def hashes(self) -> np.ndarray:
        """64 bits of each word: a polynomial over its bytes, finalised with its length."""
        n = len(self.buf)
        p = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * p[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * p[n - self.start]
        # the exponent is now n for every word: take it out by folding n only through positions relative to the block
        return mix(h * _inverse_power(n) ^ (self.end - self.start).astype(np.uint64))


_INVERSE = pow(int(_BASE), -1, 1 << 64)


def _inverse_power(n: int) -> np.uint64:
    return _U(pow(_INVERSE, n, 1 << 64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """64 bits of each run of k consecutive hashes."""
    m = len(h) - k + 1
    out = np.zeros(max(m, 0), np.uint64)
    for j in range(k if m > 0 else 0):
        out += h[j : j + m] * _FOLD[j]
    return mix(out ^ _U(k))
