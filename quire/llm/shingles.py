"""Word shingles of whole texts and their minwise signatures (NumPy, inside Arrow tasks).

A word is a maximal run of characters other than U+0020 and U+0009-U+000D, after
lower-casing A-Z only.  On UTF-8 bytes both rules are byte rules.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64-bit word."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(64, 1 << (n - 1).bit_length())
        _POWERS = np.concatenate(
            [np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
    return _POWERS


def byte_runs(b: bytes, inside: np.ndarray) -> np.ndarray:
    """64-bit hash of each maximal run of bytes that ``inside`` (256 flags) has, in order."""
    b = np.frombuffer(b, dtype=np.uint8)
    space = ~inside[b]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    run = np.arange(len(b)) - np.repeat(
        np.concatenate([[0], starts[1:]]),
        np.diff(np.concatenate([[0], starts[1:], [len(b)]])))
    run[:starts[0]] = 0
    run[space] = 0
    if starts[0]:
        run[starts[0]:(starts[1] if len(starts) > 1 else len(b))] -= starts[0]
        run[space] = 0
    v = _BYTE[b] * _powers(int(run.max()) + 1)[run]
    v[space] = 0
    return mix64(np.add.reduceat(v, starts))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of lower-cased UTF-8 bytes, in text order."""
    return byte_runs(data, ~_SPACE)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text.

    Fewer words than ``width``: the whole word sequence is the one shingle.  No
    words (null, empty or blank text): the empty set.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * _BASE + w[j:j + n]
    h = np.sort(mix64(h))
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = h[1:] != h[:-1]
    return h[keep]


def permutation_constants(n_coords: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 2**62, n_coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n_coords, dtype=np.uint64)
    return mul, add


def signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One minwise value (upper 32 bits) per coordinate; the sets' agreement rate is their Jaccard."""
    out = np.full(len(mul), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), 512):
        part = shingles[lo:lo + 512]
        v = (part[None, :] ^ add[:, None]) * mul[:, None]
        v ^= v >> np.uint64(32)
        v *= _BASE
        np.minimum(out, v.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(intersection, union) sizes of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    inter = int(np.count_nonzero(b[at] == a)) if len(b) else 0
    return inter, len(a) + len(b) - inter
