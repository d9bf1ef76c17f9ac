"""Word shingles as 64-bit hashes: words split at ASCII white space, A-Z in lower case."""

from __future__ import annotations

import numpy as np
import xxhash

from ownerscope.llm.common import mix64

_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Looking words up in a store takes longer than hashing them, and the store stays in the worker."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all k-word shingles; of fewer words, one of the whole sequence; of none, nothing."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(n, k)
    total = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        total += hashes[j:n - size + 1 + j] * _FACTORS[j]
    return np.unique(mix64(total))
