"""Word shingles and MinHash signatures of Arrow batches, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. ``bytes.lower`` and
``bytes.split`` treat exactly these characters in just this way, so both work on UTF-8 bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: A word's 64-bit hash is looked up here first; the dictionary is emptied at this many words.
CACHED_WORDS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, computed when first met."""

    def __init__(self, most: int = CACHED_WORDS):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of one whole text as sorted 64-bit hashes.

    A text of fewer than ``width`` words has one shingle, its whole sequence; one without words none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    get = hashes.__getitem__
    h = np.fromiter(map(get, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):  # each step is a bijection of what came before, and so of the sequence up to 64 bits
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[i : len(h) - n + 1 + i]
    out = mix64(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


class MinHash:
    """``count`` independent minima of a set of 64-bit hashes, each cut to ``bits`` bits."""

    def __init__(self, count: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.a = r.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, count, dtype=np.uint64)

    def signature(self, shingles: np.ndarray, block: int = 4096) -> np.ndarray:
        """uint32 values; ``shingles`` is not empty. Long sets go block by block."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), block):
            x = shingles[i : i + block]
            low = np.minimum(low, (x[None, :] * self.a[:, None] + self.b[:, None]).min(axis=1))
        return (mix64(low) >> np.uint64(32)).astype(np.uint32)


def set_digest(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for the whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
