"""Hashes of the shingles of a text."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of the lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[:-k])).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def words_id(text: bytes) -> int:
    """A hash of the lower-cased words."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 1)
