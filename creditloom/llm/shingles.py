"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: multipliers of a 64-bit mixer
_PLACES = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than the six ASCII white spaces, with A-Z lowered."""
    return (text or b"").lower().split()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct shingles of five words; the whole sequence as one if there are fewer; none without words."""
    own = words(text)
    if not own:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in own), dtype=np.uint64, count=len(own))
    size = min(SHINGLE, len(own))
    count = len(own) - size + 1
    total = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        total += mix(hashes[k : k + count] ^ _PLACES[k])
        total = mix(total)
    return np.unique(total)
