"""Code-blocks: bit-plane coding of quantised coefficients, in both directions by one walk."""

from __future__ import annotations

import numpy as np

from codelake.kernels.arithmetic import RUN, UNIFORM, Decoder, Encoder, Raw, fresh

BYPASS, RESET, TERMINATE, CAUSAL, MARKS = 1, 2, 4, 8, 32
MOST_PLANES = 30


def ends_segment(index: int, style: int) -> bool:
    """Whether the coder is terminated after pass ``index``."""
    return bool(style & TERMINATE) or bool(style & BYPASS) and (index == 9 or index > 9 and (index - 10) % 3 != 0)


def is_raw(index: int, style: int) -> bool:
    return bool(style & BYPASS) and index >= 10 and (index - 10) % 3 != 2


def _significance(kind: str) -> list[int]:
    """Context of (horizontal, vertical, diagonal) significant neighbours at 15 h + 5 v + d."""
    out = []
    for i in range(45):
        h, v, d = i // 15, i // 5 % 3, i % 5
        if kind == "HL":
            h, v = v, h
        if kind == "HH":
            s = h + v
            out.append(8 if d >= 3 else (7 if s else 6) if d == 2 else min(s, 2) + 3 if d == 1 else min(s, 2))
        elif h == 2:
            out.append(8)
        elif h == 1:
            out.append(7 if v else 6 if d else 5)
        else:
            out.append(v + 2 if v else min(d, 2))
    return out


_SIGNIFICANCE = {k: _significance(k) for k in ("LL", "LH", "HL", "HH")}
_SIGN = {(h, v): (9 + abs(3 * h + v if h else v) if (h, v) != (0, 0) else 9, int(3 * h + v < 0)) for h in (-1, 0, 1) for v in (-1, 0, 1)}


class Plane:
    """One block's state, with a border of one cell; ``coder(kind, context, value)`` reads or writes a decision."""

    def __init__(self, width: int, height: int, band: str, style: int) -> None:
        self.w, self.h, self.s, self.style = width, height, width + 2, style
        n = (width + 2) * (height + 2)
        self.sig, self.neg, self.seen, self.fine, self.mag, self.last = ([0] * n for _ in range(6))
        self.table = _SIGNIFICANCE[band]

    def context(self, i: int, low: bool) -> int:
        g, s = self.sig, self.s
        if low:
            return self.table[15 * (g[i - 1] + g[i + 1]) + 5 * g[i - s] + g[i - s - 1] + g[i - s + 1]]
        return self.table[15 * (g[i - 1] + g[i + 1]) + 5 * (g[i - s] + g[i + s]) + g[i - s - 1] + g[i - s + 1] + g[i + s - 1] + g[i + s + 1]]

    def sign(self, i: int, low: bool) -> tuple[int, int]:
        g, m, s = self.sig, self.neg, self.s
        h = g[i - 1] * (1 - 2 * m[i - 1]) + g[i + 1] * (1 - 2 * m[i + 1])
        v = g[i - s] * (1 - 2 * m[i - s]) + (0 if low else g[i + s] * (1 - 2 * m[i + s]))
        return _SIGN[max(-1, min(1, h)), max(-1, min(1, v))]

    def cells(self):
        """(index, whether its row is the last of a stripe) column by column in stripes of four rows."""
        causal = bool(self.style & CAUSAL)
        for top in range(0, self.h, 4):
            for x in range(self.w):
                for y in range(top, min(top + 4, self.h)):
                    yield (y + 1) * self.s + x + 1, causal and y == top + 3

    def start(self, i: int, low: bool, p: int, coder, raw: bool) -> None:
        if raw:  # raw signs are literal
            self.neg[i] = coder.sign(i, 0, 0)
        else:
            k, flip = self.sign(i, low)
            self.neg[i] = coder.sign(i, k, flip)
        self.sig[i] = 1
        self.mag[i] |= 1 << p
        self.last[i] = p

    def propagate(self, p: int, coder, raw: bool) -> None:
        for i, low in self.cells():
            if not self.sig[i]:
                k = self.context(i, low)
                if k:
                    self.seen[i] = 1
                    if coder.bit(i, k, p):
                        self.start(i, low, p, coder, raw)

    def refine(self, p: int, coder, raw: bool) -> None:
        for i, low in self.cells():
            if self.sig[i] and not self.seen[i]:
                k = 16 if self.fine[i] else 15 if self.context(i, low) else 14
                if coder.bit(i, k, p):
                    self.mag[i] |= 1 << p
                self.last[i] = p
                self.fine[i] = 1

    def clean(self, p: int, coder) -> None:
        causal = bool(self.style & CAUSAL)
        sig, seen, s = self.sig, self.seen, self.s
        for top in range(0, self.h, 4):
            for x in range(self.w):
                i = (top + 1) * s + x + 1
                rows = min(4, self.h - top)
                first, forced = 0, False
                column = range(i, i + rows * s, s)
                if rows == 4 and not any(sig[j] or seen[j] or self.context(j, causal and j == i + 3 * s) for j in column):
                    run = coder.run(i, s, p)
                    if run is None:
                        continue
                    first, forced = run, True
                for y in range(first, rows):
                    j, low = i + y * s, causal and y == 3
                    if forced or not sig[j] and not seen[j]:
                        if forced or coder.bit(j, self.context(j, low), p):
                            self.start(j, low, p, coder, False)
                        forced = False
                for j in column:
                    seen[j] = 0
        if self.style & MARKS:
            coder.marks()


class _Reads:
    def __init__(self, source) -> None:
        self.get = source.bit

    def bit(self, _i: int, k: int, _p: int) -> int:
        return self.get(k)

    def sign(self, _i: int, k: int, flip: int) -> int:
        return self.get(k) ^ flip

    def run(self, _i: int, _s: int, _p: int) -> int | None:
        return self.get(UNIFORM) << 1 | self.get(UNIFORM) if self.get(RUN) else None

    def marks(self) -> None:
        for _ in range(4):
            self.get(UNIFORM)


class _Writes:
    def __init__(self, put, value: list[int], negative: list[int]) -> None:
        self.put, self.value, self.negative = put, value, negative

    def bit(self, i: int, k: int, p: int) -> int:
        b = self.value[i] >> p & 1
        self.put(k, b)
        return b

    def sign(self, i: int, k: int, flip: int) -> int:
        self.put(k, self.negative[i] ^ flip)
        return self.negative[i]

    def run(self, i: int, s: int, p: int) -> int | None:
        first = next((y for y in range(4) if self.value[i + y * s] >> p & 1), None)
        self.put(RUN, int(first is not None))
        if first is not None:
            self.put(UNIFORM, first >> 1)
            self.put(UNIFORM, first & 1)
        return first

    def marks(self) -> None:
        for b in (1, 0, 1, 0):
            self.put(UNIFORM, b)


def _step(state: Plane, index: int, p: int, coder, raw: bool) -> None:
    if index == 0 or index % 3 == 0:
        state.clean(p, coder)
    elif index % 3 == 1:
        state.propagate(p, coder, raw)
    else:
        state.refine(p, coder, raw)


def decode(width: int, height: int, band: str, planes: int, style: int, segments: list[tuple[int, bytes]]) -> np.ndarray:
    """Signed coefficients, row by row; a coefficient whose lower planes are missing is set to the middle of its
    interval. ``segments``: (number of passes, bytes)."""
    state = Plane(width, height, band, style)
    planes = min(planes, MOST_PLANES)
    cx, index = fresh(), 0
    for passes, data in segments:
        source, kind = None, None
        for _ in range(passes):
            p = planes - 1 - (index + 2) // 3
            if p < 0:
                break
            raw = is_raw(index, style)
            if source is None or raw != kind:
                source, kind = (Raw(data) if raw else Decoder(data, cx)), raw
            _step(state, index, p, _Reads(source), raw)
            if style & RESET:
                cx[:] = fresh()
            index += 1
    mag, last, neg = (np.array(x, np.int64).reshape(height + 2, width + 2)[1:-1, 1:-1] for x in (state.mag, state.last, state.neg))
    whole = np.where(mag > 0, mag + ((np.int64(1) << last) >> 1), 0)
    return np.where(neg == 1, -whole, whole)


def encode(values: np.ndarray, band: str) -> tuple[int, int, bytes]:
    """(planes, passes, bytes) of a block in one segment, for writing test and round-trip files."""
    height, width = values.shape
    mag = np.zeros((height + 2, width + 2), np.int64)
    mag[1:-1, 1:-1] = np.abs(values)
    neg = np.zeros((height + 2, width + 2), np.int64)
    neg[1:-1, 1:-1] = values < 0
    planes = int(mag.max()).bit_length()
    if not planes:
        return 0, 0, b""
    out = Encoder(fresh())
    state, coder = Plane(width, height, band, 0), _Writes(out.bit, mag.ravel().tolist(), neg.ravel().tolist())
    passes = 3 * planes - 2
    for index in range(passes):
        _step(state, index, planes - 1 - (index + 2) // 3, coder, False)
    return planes, passes, out.end()
