"""Words, shingles and their hashes, for whole texts as UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_ODD = (np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes that are no ASCII white space."""
    return text.lower().split()


def shingles(w: list[bytes], k: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*[w[i:] for i in range(k)]))


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x += hashes[i : i + n] * _ODD[i]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
