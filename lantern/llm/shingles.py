"""64-bit hashes of words and word shingles, computed on byte arrays."""

from __future__ import annotations

import numpy as np
import xxhash

BLANKS = b" \t\n\v\f\r"
#: Lower-cases A-Z and turns every separator into a space.
FOLD = bytes(32 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = 0x9E3779B97F4A7C17
_WIDE = 1 << 20
#: Polynomials modulo 2^64 have collisions by construction from about a thousand bytes on; longer words take another hash.
_LONG_WORD = 128

_random = np.random.default_rng(20250117)
_letters = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 14)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _tables[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word of UTF-8 text, in order."""
    text = raw.translate(FOLD)
    if len(text) <= _WIDE:
        return _segment(text)
    parts, at = [], 0
    while at < len(text):
        stop = at + _WIDE
        if stop < len(text):
            cut = text.rfind(b" ", at, stop)
            cut = text.find(b" ", stop) if cut < 0 else cut
            stop = len(text) if cut < 0 else cut + 1
        parts.append(_segment(text[at:stop]))
        at = stop
    return np.concatenate(parts)


def _segment(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    blank = np.ones(len(b) + 2, np.int8)
    blank[1:-1] = b == 32
    edges = np.flatnonzero(np.diff(blank))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_letters[b] * up[: len(b)], out=sums[1:])
    found = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > _LONG_WORD).tolist():
        found[k] = xxhash.xxh3_64_intdigest(text[starts[k] : ends[k]], 1)
    return found


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of two-word shingles; of a lone word, its own."""
    if len(words) < 2:
        return mix(words + np.uint64(0x1234567))
    return np.unique(mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + (words[1:] ^ (words[1:] >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)))


class MinHash:
    """``bands`` x ``rows`` universal hash minima and a key for each band."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = r.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.weights = r.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = r.integers(1, 1 << 63, bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 1024):
            h = np.multiply.outer(self.a, shingles[at : at + 1024])
            h += self.b[:, None]
            np.minimum(least, h.min(axis=1), out=least)
        return least >> np.uint64(32)

    def keys(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A key for each band, and one bit of each minimum in 64-bit words."""
        s = self.signature(shingles)
        bits = np.zeros(-(-len(s) // 64) * 64, np.uint8)
        bits[: len(s)] = s & np.uint64(1)
        s = s.reshape(self.bands, self.rows)
        keys = mix((mix(s) * self.weights).sum(axis=1, dtype=np.uint64) + self.salts)
        return keys.view(np.int64), np.packbits(bits).view(np.int64)
