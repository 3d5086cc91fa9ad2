"""64- and 128-bit hashes of words, word shingles and text units, in numpy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest, xxh3_128_digest

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works on a copy."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text with A-Z lower-cased (``bytes`` methods touch ASCII only)."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    size = min(size, len(h))
    out = h[: len(h) - size + 1]
    for k in range(1, size):
        out = mix(out) * _STEP + h[k : len(h) - size + 1 + k]
    return np.unique(mix(out))


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a sorted set of hashes."""
    return xxh3_128_digest(hashes.tobytes())


class MinHasher:
    """``bands * rows`` universal hash minima of a set of 64-bit hashes."""

    BLOCK = 1024

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        n = bands * rows
        self.a = rng.integers(0, 2**64, n, np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, n, np.uint64)
        self.band_seed = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """Minimum of ``a * x + b`` modulo 2**64 over the set, for each (a, b)."""
        out = np.full(len(self.a), np.uint64(2**64 - 1))
        for at in range(0, len(hashes), self.BLOCK):
            grid = np.multiply.outer(self.a, hashes[at : at + self.BLOCK])
            grid += self.b[:, None]
            np.minimum(out, grid.min(axis=1), out=out)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key per document and band; ``minima`` has a row per document."""
        parts = minima.reshape(-1, self.bands, self.rows)
        key = np.broadcast_to(self.band_seed, parts.shape[:2]).copy()
        for k in range(self.rows):
            key = mix(key * _STEP + parts[:, :, k])
        return key.view(np.int64)

    @staticmethod
    def signature(minima: np.ndarray) -> np.ndarray:
        """16 mixed bits of each minimum: enough to estimate a similarity."""
        return (mix(minima) >> np.uint64(48)).astype(np.uint16)
