"""Shingles of a text, runs of words without regard to the case of A to Z, as hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """Hashes of all shingles; a text of up to ``shingle`` words is one."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return []
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [hashed(joined, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return [hashed(joined[a:b], SEED)
            for a, b in zip((ends - sizes)[:1 - shingle].tolist(), ends[shingle - 1:].tolist())]
