"""Word shingles of whole texts as 64-bit hashes, and minwise signatures of shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tidewatch.llm.tokens import words

COORDINATES = 96
_MIX, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_RNG = np.random.default_rng(20240601)
_FACTORS = (_RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MORE
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text, and where each text begins (one more entry than texts).

    A-Z are lower-cased. A text with fewer than k words, but at least one, has one shingle, its whole sequence.
    """
    found = words(pc.ascii_lower(pa.array(texts, pa.large_string())).to_pylist())
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, found.distinct), np.uint64, len(found.distinct))
    h = distinct[found.codes] if len(found.codes) else np.zeros(0, np.uint64)
    n = np.diff(found.offsets)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(starts[-1], np.uint64)
    # Shingles that would cross into the next text are computed and left out.
    whole = np.zeros(len(h), np.uint64)
    for i in range(k):
        m = max(0, len(h) - i)
        whole[:m] = mix(whole[:m] * _MIX + h[i:] + np.uint64(k))
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(h)) - found.offsets[:-1][owner] < counts[owner]
    long = (n >= k)[owner] & inside
    target = np.repeat(n >= k, counts)
    out[target] = whole[long]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        own = h[found.offsets[i]:found.offsets[i + 1]]
        out[starts[i]] = np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own)))
    return out, starts


def sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, starts = shingle_hashes(texts, k)
    return [np.unique(h[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each set COORDINATES minwise values of 16 bits; sets must not be empty."""
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(starts) - 1, COORDINATES), np.uint16)
    for i in range(COORDINATES):
        least = np.minimum.reduceat(low * _FACTORS[i] ^ _SHIFTS[i], starts[:-1])
        out[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out
