"""Wavelet synthesis of both filters along one axis and over whole tile components, and the analysis for writing."""

from __future__ import annotations

import numpy as np

#: Fixed values of the irreversible filter.
ALPHA, BETA, GAMMA, DELTA, K = (np.float32(x) for x in (-1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971, 1.230174104914001))
LIMIT = 2**31 - 1


def _mirror(i: np.ndarray, n: int) -> np.ndarray:
    period = max(2 * n - 2, 1)
    i = np.mod(i, period)
    return np.where(i < n, i, period - i)


def _lift(x: np.ndarray, parity: int, rule) -> None:
    """Adds ``rule(left, right)`` to every second row of x, from ``parity`` on; the edges are mirrored."""
    n = len(x)
    at = np.arange(parity, n, 2)
    x[at] = rule(x[at], x[_mirror(at - 1, n)], x[_mirror(at + 1, n)])


def synthesise_53(x: np.ndarray, start: int) -> np.ndarray:
    """Inverse 5/3 along the first axis of interleaved coefficients whose first one stands at ``start``."""
    x = x.astype(np.int64)
    even = start & 1  # rows at even places start here
    if len(x) == 1:
        return np.trunc(x / 2).astype(np.int64) if even else x
    _lift(x, even, lambda c, a, b: np.clip(c - ((a + b + 2) >> 2), -LIMIT - 1, LIMIT))
    _lift(x, 1 - even, lambda c, a, b: np.clip(c + ((a + b) >> 1), -LIMIT - 1, LIMIT))
    return x


def analyse_53(x: np.ndarray, start: int) -> np.ndarray:
    x = x.astype(np.int64)
    even = start & 1
    if len(x) == 1:
        return 2 * x if even else x
    _lift(x, 1 - even, lambda c, a, b: c - ((a + b) >> 1))
    _lift(x, even, lambda c, a, b: c + ((a + b + 2) >> 2))
    return x


def synthesise_97(x: np.ndarray, start: int) -> np.ndarray:
    """Inverse 9/7 along the first axis, in single precision."""
    x = x.astype(np.float32)
    even = start & 1
    if len(x) == 1:
        return x / np.float32(2) if even else x
    x[even::2] *= K
    x[1 - even :: 2] /= K
    for parity, f in ((even, DELTA), (1 - even, GAMMA), (even, BETA), (1 - even, ALPHA)):
        _lift(x, parity, lambda c, a, b, f=f: c - f * (a + b))
    return x


def analyse_97(x: np.ndarray, start: int) -> np.ndarray:
    """The 9/7 filter along the first axis, in double precision."""
    x = x.astype(np.float64)
    even = start & 1
    if len(x) == 1:
        return 2 * x if even else x
    for parity, f in ((1 - even, ALPHA), (even, BETA), (1 - even, GAMMA), (even, DELTA)):
        _lift(x, parity, lambda c, a, b, f=float(f): c + f * (a + b))
    x[even::2] /= float(K)
    x[1 - even :: 2] *= float(K)
    return x


def interleave(bands: dict[str, np.ndarray], x0: int, y0: int, x1: int, y1: int, kind) -> np.ndarray:
    """The four bands of one level by the parity of their absolute places."""
    out = np.zeros((y1 - y0, x1 - x0), kind)
    for name, (ox, oy) in {"LL": (0, 0), "HL": (1, 0), "LH": (0, 1), "HH": (1, 1)}.items():
        part = out[(oy - y0) % 2 :: 2, (ox - x0) % 2 :: 2]
        part[...] = bands[name][: part.shape[0], : part.shape[1]]
    return out


def synthesise(levels: list[tuple[tuple[int, int, int, int], dict[str, np.ndarray]]], reversible: bool) -> np.ndarray:
    """A tile component from its resolutions, lowest first: (rectangle, bands); rows first, then columns."""
    step, kind = (synthesise_53, np.int64) if reversible else (synthesise_97, np.float32)
    low = levels[0][1]["LL"].astype(kind)
    for (x0, y0, x1, y1), bands in levels[1:]:
        x = interleave({"LL": low, **bands}, x0, y0, x1, y1, kind)
        if x.size:
            x = step(np.ascontiguousarray(x.T), x0).T
            x = step(np.ascontiguousarray(x), y0)
        low = x
    return low


def analyse(x: np.ndarray, x0: int, y0: int, levels: int, reversible: bool = True) -> list[dict[str, np.ndarray]]:
    """Bands of ``levels`` levels, lowest resolution first."""
    step = analyse_53 if reversible else analyse_97
    out: list[dict[str, np.ndarray]] = []
    for _ in range(levels):
        if x.size:
            x = step(np.ascontiguousarray(x), y0)
            x = step(np.ascontiguousarray(x.T), x0).T
        part = {n: x[(oy - y0) % 2 :: 2, (ox - x0) % 2 :: 2] for n, (ox, oy) in {"LL": (0, 0), "HL": (1, 0), "LH": (0, 1), "HH": (1, 1)}.items()}
        out.append({k: part[k] for k in ("HL", "LH", "HH")})
        x, x0, y0 = part["LL"], -(-x0 // 2), -(-y0 // 2)
    return [{"LL": x}, *reversed(out)]
