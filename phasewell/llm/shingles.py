"""Sets of word shingles and their MinHash signatures, as numpy kernels."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Words whose hashes a worker remembers, in all stages that it serves, and the longest word that it remembers; the common
#: words come back at once when it has forgotten them, so more would hold memory and save no time.
REMEMBERED = 50_000
LONGEST = 48
WORDS = 5


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        own = xxhash.xxh3_64_intdigest(word.encode())
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = own
        return own


_HASHES = _Hashes()


def words(text: str) -> list[str]:
    """The words of a text, A to Z in lower case, cut at spaces and the control characters 9 to 13."""
    return _WORD.findall(text.translate(_LOWER))


def shingle_set(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of n words; of all words as one, where there are fewer."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        hashes = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
        width = min(n, len(found))
        out = np.full(len(found) - width + 1, np.uint64(width))
        for i in range(width):
            out = (out ^ hashes[i : i + len(out)]) * _M
            out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


class MinHash:
    """Universal hashes (a x + b) >> 32 modulo 2^64 of the upper 32 bits of each shingle; their minima, banded."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.a = rng.integers(1, 1 << 63, k, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        x = (shingles >> np.uint64(32))[None, :]
        with np.errstate(over="ignore"):
            for begin in range(0, x.shape[1], 1024):  # stays in the cache
                part = x[:, begin : begin + 1024]
                for at in range(0, len(out), 16):
                    h = part * self.a[at : at + 16, None]
                    h += self.b[at : at + 16, None]
                    np.minimum(out[at : at + 16], h.min(1), out=out[at : at + 16])
        return (out >> np.uint64(32)).astype(np.uint32)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        with np.errstate(over="ignore"):
            key = np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX
            for row in minima.reshape(self.bands, self.rows).T.astype(np.uint64):
                key = (key ^ row) * _M
                key ^= key >> np.uint64(31)
        return key.view(np.int64)
