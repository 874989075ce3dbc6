"""Hashed word shingles of whole batches of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import utf8_parts

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: pa.Array, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Hashes of the words of each text: runs of ASCII letters, digits and non-ASCII characters, in lower case.

    Texts are taken about ``most`` bytes at a time, as the arrays of a step are many times larger than its texts.
    """
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield from _word_hashes(texts.slice(start, stop - start))
        start = stop


def _word_hashes(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8_parts(pc.utf8_lower(texts))
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(texts)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    place = at - starts[word]
    values = _BYTE[data[at]] * powers(_BASE, int(place.max()) + 1)[place]
    hashes = mix(np.add.reduceat(values, np.searchsorted(at, starts)))
    return np.split(hashes, np.searchsorted(starts, offsets[1:-1]))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """One hash for each ``width`` words in a row; a shorter text that has words is one shingle."""
    n = len(words)
    if n < width:
        return mix(np.array([(words * powers(_BASE, n)).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)) if n else np.zeros(0, np.uint64)
    p, s = powers(_BASE, width), np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        s += words[j : n - width + 1 + j] * p[j]
    return mix(s)


def fingerprint(words: np.ndarray, text) -> bytes:
    """Equal for equal word sequences; a text without words is known by its own characters."""
    if len(words):
        return hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    return hashlib.blake2b(text.as_py().encode(), digest_size=16, key=b"t").digest()
