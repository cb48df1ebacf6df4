"""Vectorised word hashing: a batch of texts becomes arrays of 64-bit word hashes, without a Python loop over words."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = (np.ones(1, U), np.ones(1, U))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, U(_BASE)), np.full(size, U(_INV))
        up[0] = down[0] = U(1)
        _powers = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
    return _powers[0][:n], _powers[1][:n]


def slices(texts: list[str | None], size: int = 1_000_000) -> Iterator[slice]:
    """Consecutive slices of about ``size`` characters; a longer text is a slice of its own, whole."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > size:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))


def words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of anything but x20, x09-x0D) of all texts, and each text's first word's place.

    A null text has no words. The second array has one entry more than there are texts.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if not raw:
        return np.zeros(0, U), np.zeros(1, np.int64)
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, last = edge[0::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((_LOWER if lower else _BYTE)[buf] * up[:-1], out=total[1:])
    hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(U))
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    return hashes, np.searchsorted(first, begin)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (only places with k words left)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out += hashes[j : j + n] * _PLACE[j]
    return mix(out + U(k))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; the whole sequence where there are fewer words."""
    hashes, place = words(texts)
    every = grams(hashes, k)
    out = []
    for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(grams(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def return_memory() -> None:
    """Gives back to the system what this process's allocators have freed."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
        if trim:
            trim(0)


def returning_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker that is used again keeps what its allocators have freed; after each task this gives it back."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        return_memory()

    return inner
