"""Many code-blocks at once: the passes and the coder of ``blocks`` and ``arithmetic`` as array operations, with one
lane a block. Blocks of one shape and style walk through their cells together; a cell's state is a row over all lanes,
and only lanes that have something to code there are touched. Bands differ by their context table only.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from codelake.kernels import blocks
from codelake.kernels.arithmetic import CONTEXTS, RUN, STATES, UNIFORM, fresh

_Q = np.repeat([s[0] for s in STATES], 2).astype(np.int64)
_LIKELY = np.array([2 * s[1] + m for s in STATES for m in (0, 1)], np.uint8)
_UNLIKELY = np.array([2 * s[2] + (m ^ s[3]) for s in STATES for m in (0, 1)], np.uint8)
_SHIFTS = (16 - np.floor(np.log2(np.maximum(np.arange(1 << 15), 1))).astype(np.int64) - 1).astype(np.int64)
_KINDS = ("LL", "HL", "LH", "HH")
_TABLE = np.zeros((4, 45 + 5), np.int64)
for _i, _k in enumerate(_KINDS):
    _TABLE[_i, :45] = blocks._SIGNIFICANCE[_k]
_SIGN_CONTEXT = np.array([blocks._SIGN[max(-1, min(1, h)), max(-1, min(1, v))][0] for h in range(-2, 3) for v in range(-2, 3)])
_SIGN_FLIP = np.array([blocks._SIGN[max(-1, min(1, h)), max(-1, min(1, v))][1] for h in range(-2, 3) for v in range(-2, 3)], np.uint8)


class _Contexts:
    def __init__(self, n: int) -> None:
        self.cx = np.zeros((CONTEXTS, n), np.uint8)
        self.reset(np.arange(n))

    def reset(self, lanes: np.ndarray) -> None:
        self.cx[:, lanes] = np.array(fresh(), np.uint8)[:, None]


class Reading(_Contexts):
    """Arithmetic and raw readers of all lanes. Past the end of a segment they see ones, as the scalar ones do."""

    def __init__(self, n: int, data: np.ndarray) -> None:
        super().__init__(n)
        self.data = data
        self.a, self.c, self.left, self.at, self.stop = (np.zeros(n, np.int64) for _ in range(5))

    def begin(self, lanes: np.ndarray, at: np.ndarray, stop: np.ndarray, raw: bool) -> None:
        self.at[lanes], self.stop[lanes] = at, stop
        if raw:
            self.left[lanes] = self.c[lanes] = 0
            self.a[lanes] = at
            return
        self.c[lanes] = self._peek(lanes, at) << 16
        self._byte(lanes)
        self.c[lanes] <<= 7
        self.left[lanes] -= 7
        self.a[lanes] = 0x8000

    def _peek(self, lanes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at < self.stop[lanes], self.data[np.minimum(at, len(self.data) - 1)], 0xFF).astype(np.int64)

    def _byte(self, lanes: np.ndarray) -> None:
        at = self.at[lanes]
        now, after = self._peek(lanes, at), self._peek(lanes, at + 1)
        full, marker = now == 0xFF, after > 0x8F
        stuck = full & marker
        self.c[lanes] += np.where(stuck, 0xFF00, np.where(full, after << 9, after << 8))
        self.left[lanes] = np.where(full & ~marker, 7, 8)
        self.at[lanes] = np.where(stuck, at, at + 1)

    def bit(self, lanes: np.ndarray, k: np.ndarray | int, _value: object = None) -> np.ndarray:
        s = self.cx[k, lanes]
        q = _Q[s]
        c = self.c[lanes]
        a = self.a[lanes] - q
        low, swap = (c >> 16) < q, a < q
        unlikely = low != swap
        again = low | (a < 0x8000)
        a = np.where(low, q, a)
        self.c[lanes] = np.where(low, c, c - (q << 16))
        self.a[lanes] = a
        r = np.flatnonzero(again)
        if len(r):
            u, s_r = unlikely[r], s[r]
            self.cx[k if isinstance(k, int) else k[r], lanes[r]] = np.where(u, _UNLIKELY[s_r], _LIKELY[s_r])
            shift = _SHIFTS[a[r]]
            r = lanes[r]
            while len(r):
                out = r[self.left[r] == 0]
                if len(out):
                    self._byte(out)
                m = np.minimum(shift, self.left[r])
                self.a[r] <<= m
                self.c[r] <<= m
                self.left[r] -= m
                shift = shift - m
                go = shift > 0
                r, shift = r[go], shift[go]
        return (s & 1) ^ unlikely

    def raw(self, lanes: np.ndarray, _value: object = None) -> np.ndarray:
        """``a`` is where the segment began, ``c`` the byte."""
        new = lanes[self.left[lanes] == 0]
        if len(new):
            at = self.at[new]
            self.left[new] = np.where((self.c[new] == 0xFF) & (at > self.a[new]), 7, 8)
            self.c[new] = self._peek(new, at)
            self.at[new] = at + 1
        self.left[lanes] -= 1
        return (self.c[lanes] >> self.left[lanes] & 1).astype(np.uint8)


class Writing(_Contexts):
    """Arithmetic and raw writers of all lanes; ``end`` gives finished segments."""

    def __init__(self, n: int) -> None:
        super().__init__(n)
        self.a, self.c, self.left, self.size = (np.zeros(n, np.int64) for _ in range(4))
        self.out = np.zeros((n, 64), np.uint8)
        self.begin(np.arange(n), False)

    def begin(self, lanes: np.ndarray, raw: bool) -> None:
        self.a[lanes], self.c[lanes], self.left[lanes], self.size[lanes] = 0x8000, 0, 8 if raw else 12, 1
        self.out[lanes, 0] = 0

    def _append(self, lanes: np.ndarray, byte: np.ndarray) -> None:
        if self.size[lanes].max() + 1 >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[lanes, self.size[lanes]] = byte
        self.size[lanes] += 1

    def _byte(self, lanes: np.ndarray) -> None:
        c, last = self.c[lanes], self.out[lanes, self.size[lanes] - 1]
        carry = (last != 0xFF) & (c & 0x8000000 != 0)
        bumped = lanes[carry]
        self.out[bumped, self.size[bumped] - 1] += 1
        c = np.where(carry, c & 0x7FFFFFF, c)
        stuff = (last == 0xFF) | carry & (last == 0xFE)
        self._append(lanes, np.where(stuff, c >> 20, c >> 19) & 0xFF)
        self.c[lanes] = np.where(stuff, c & 0xFFFFF, c & 0x7FFFF)
        self.left[lanes] = np.where(stuff, 7, 8)

    def bit(self, lanes: np.ndarray, k: np.ndarray | int, value: np.ndarray) -> np.ndarray:
        s = self.cx[k, lanes]
        q = _Q[s]
        a = self.a[lanes] - q
        likely, swap = value == (s & 1), a < q
        again = ~likely | (a < 0x8000)
        add = likely != swap
        self.c[lanes] += np.where(add, q, 0)
        a = np.where(add, a, q)
        self.a[lanes] = a
        r = np.flatnonzero(again)
        if len(r):
            u, s_r = likely[r], s[r]
            self.cx[k if isinstance(k, int) else k[r], lanes[r]] = np.where(u, _LIKELY[s_r], _UNLIKELY[s_r])
            shift = _SHIFTS[a[r]]
            r = lanes[r]
            while len(r):
                m = np.minimum(shift, self.left[r])
                self.a[r] <<= m
                self.c[r] <<= m
                self.left[r] -= m
                out = r[self.left[r] == 0]
                if len(out):
                    self._byte(out)
                shift = shift - m
                go = shift > 0
                r, shift = r[go], shift[go]
        return value

    def raw(self, lanes: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Raw bits gather in ``c``; a byte has seven of them after an FF."""
        self.left[lanes] -= 1
        self.c[lanes] |= value.astype(np.int64) << self.left[lanes]
        self._flush(lanes[self.left[lanes] == 0])
        return value

    def _flush(self, full: np.ndarray) -> None:
        if len(full):
            byte = self.c[full]
            self._append(full, byte)
            self.left[full], self.c[full] = np.where(byte == 0xFF, 7, 8), 0

    def end(self, lanes: np.ndarray, raw: bool) -> list[bytes]:
        if raw:
            after = self.out[lanes, self.size[lanes] - 1] == 0xFF
            self._flush(lanes[self.left[lanes] < np.where(after & (self.size[lanes] > 1), 7, 8)])
        else:
            full = self.c[lanes] + self.a[lanes]
            c = self.c[lanes] | 0xFFFF
            self.c[lanes] = np.where(c >= full, c - 0x8000, c)
            for _ in range(2):
                self.c[lanes] <<= self.left[lanes]
                self._byte(lanes)
        size = self.size[lanes]
        size = size - ((self.out[lanes, size - 1] == 0xFF) & (size > 1))
        return [self.out[i, 1:n].tobytes() for i, n in zip(lanes.tolist(), size.tolist(), strict=True)]


class _Walk:
    """The state of all lanes; cells have a border of one. ``near`` is 15 h + 5 v + d of the significant neighbours and
    ``across``, ``along`` are the sums of their signs, both kept up to date as cells become significant."""

    def __init__(self, width: int, height: int, kinds: list[str], style: int, planes: np.ndarray, coder) -> None:  # noqa: ANN001
        self.w, self.h, self.s, self.style, self.coder, self.planes = width, height, width + 2, style, coder, planes
        cells, n = (width + 2) * (height + 2), len(kinds)
        self.sig, self.seen, self.fine = (np.zeros((cells, n), bool) for _ in range(3))
        self.neg, self.near = np.zeros((cells, n), np.uint8), np.zeros((cells, n), np.int64)
        self.across, self.along = np.zeros((cells, n), np.int8), np.zeros((cells, n), np.int8)
        self.mag, self.last = np.zeros((cells, n), np.int64), np.zeros((cells, n), np.int64)
        self.kind = np.array([_KINDS.index(k) for k in kinds])
        self.value: np.ndarray | None = None
        self.negative: np.ndarray | None = None

    def _stripes(self) -> Iterable[tuple[int, list[int]]]:
        for top in range(0, self.h, 4):
            for x in range(self.w):
                i = (top + 1) * self.s + x + 1
                yield top, [i + y * self.s for y in range(min(4, self.h - top))]

    def _context(self, i: int, lanes: np.ndarray) -> np.ndarray:
        return _TABLE[self.kind[lanes], self.near[i, lanes]]

    def _told(self, i: int, lanes: np.ndarray, p: np.ndarray) -> np.ndarray | None:
        return None if self.value is None else (self.value[i, lanes] >> p[lanes] & 1).astype(np.uint8)

    def _start(self, i: int, y: int, lanes: np.ndarray, p: np.ndarray, raw: bool) -> None:
        sign = None if self.negative is None else self.negative[i, lanes]
        if raw:  # raw signs are literal
            neg = self.coder.raw(lanes, sign)
        else:
            at = (self.across[i, lanes] + 2) * 5 + self.along[i, lanes] + 2
            flip = _SIGN_FLIP[at]
            neg = self.coder.bit(lanes, _SIGN_CONTEXT[at], None if sign is None else sign ^ flip) ^ flip
        self.neg[i, lanes] = neg
        self.sig[i, lanes] = True
        self.mag[i, lanes] |= np.int64(1) << p[lanes]
        self.last[i, lanes] = p[lanes]
        way, s = (1 - 2 * neg.astype(np.int8)).astype(np.int8), self.s
        above = not (self.style & blocks.CAUSAL and y % 4 == 0)  # the stripe above does not look down
        for j, by in ((i - 1, 15), (i + 1, 15), (i + s, 5), (i + s - 1, 1), (i + s + 1, 1), *(((i - s, 5), (i - s - 1, 1), (i - s + 1, 1)) if above else ())):
            self.near[j, lanes] += by
        for j in (i - 1, i + 1):
            self.across[j, lanes] += way
        for j in (i - s, i + s) if above else (i + s,):
            self.along[j, lanes] += way

    def propagate(self, on: np.ndarray, p: np.ndarray, raw: bool) -> None:
        for top, column in self._stripes():
            for y, i in enumerate(column):
                lanes = np.flatnonzero(on & ~self.sig[i] & (self.near[i] > 0))
                if len(lanes):
                    self.seen[i, lanes] = True
                    told = self._told(i, lanes, p)
                    got = self.coder.raw(lanes, told) if raw else self.coder.bit(lanes, self._context(i, lanes), told)
                    new = lanes[got == 1]
                    if len(new):
                        self._start(i, top + y, new, p, raw)

    def refine(self, on: np.ndarray, p: np.ndarray, raw: bool) -> None:
        for _, column in self._stripes():
            for i in column:
                lanes = np.flatnonzero(on & self.sig[i] & ~self.seen[i])
                if len(lanes):
                    told = self._told(i, lanes, p)
                    got = self.coder.raw(lanes, told) if raw else self.coder.bit(lanes, np.where(self.fine[i, lanes], 16, np.where(self.near[i, lanes] > 0, 15, 14)), told)
                    self.mag[i, lanes] |= got.astype(np.int64) << p[lanes]
                    self.last[i, lanes] = p[lanes]
                    self.fine[i, lanes] = True

    def _run(self, column: list[int], lanes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The first row that becomes significant in columns without significant neighbours; 4 for none."""
        first = np.full(len(lanes), 4)
        if self.value is None:
            hit = np.flatnonzero(self.coder.bit(lanes, RUN) == 1)
            if len(hit):
                high = self.coder.bit(lanes[hit], UNIFORM)
                first[hit] = 2 * high.astype(np.int64) + self.coder.bit(lanes[hit], UNIFORM)
            return first
        bits = np.stack([self._told(i, lanes, p) for i in column])
        first = np.where(bits.any(0), bits.argmax(0), 4)
        hit = first < 4
        self.coder.bit(lanes, RUN, hit.astype(np.uint8))
        if hit.any():
            self.coder.bit(lanes[hit], UNIFORM, (first[hit] >> 1).astype(np.uint8))
            self.coder.bit(lanes[hit], UNIFORM, (first[hit] & 1).astype(np.uint8))
        return first

    def clean(self, on: np.ndarray, p: np.ndarray) -> None:
        n = len(on)
        for top, column in self._stripes():
            first = np.full(n, -1)
            if len(column) == 4:
                quiet = on.copy()
                for i in column:
                    quiet &= ~(self.sig[i] | self.seen[i]) & (self.near[i] == 0)
                lanes = np.flatnonzero(quiet)
                if len(lanes):
                    first[lanes] = self._run(column, lanes, p)
            for y, i in enumerate(column):
                lanes = np.flatnonzero(on & ~self.sig[i] & ~self.seen[i] & (first < y))
                new = np.flatnonzero(first == y)
                if len(lanes):
                    got = self.coder.bit(lanes, self._context(i, lanes), self._told(i, lanes, p))
                    more = lanes[got == 1]
                    new = np.sort(np.concatenate([new, more])) if len(new) else more
                if len(new):
                    self._start(i, top + y, new, p, False)
            for i in column:
                self.seen[i] = False
        if self.style & blocks.MARKS:
            lanes = np.flatnonzero(on)
            for b in (1, 0, 1, 0):
                self.coder.bit(lanes, UNIFORM, np.full(len(lanes), b, np.uint8))

    def step(self, index: int, on: np.ndarray) -> None:
        p = np.maximum(self.planes - 1 - (index + 2) // 3, 0)
        raw = blocks.is_raw(index, self.style)
        if index % 3 == 0:
            self.clean(on, p)
        elif index % 3 == 1:
            self.propagate(on, p, raw)
        else:
            self.refine(on, p, raw)
        if self.style & blocks.RESET:
            self.coder.reset(np.flatnonzero(on))


def _grouped(shapes: list[tuple]) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for i, k in enumerate(shapes):
        out.setdefault(k, []).append(i)
    return out


#: Lanes of one walk: their state takes about 40 bytes a cell.
LANES = 2048


def decode_blocks(jobs: list[tuple[int, int, str, int, int, list[tuple[int, bytes]]]]) -> list[np.ndarray]:
    """What ``blocks.decode`` gives for each (width, height, band, planes, style, segments)."""
    out: list[np.ndarray | None] = [None] * len(jobs)
    for (w, h, style), every in _grouped([(j[0], j[1], j[4]) for j in jobs]).items():
        for k in range(0, len(every), LANES):
            part = every[k : k + LANES]
            for i, x in zip(part, _decode(w, h, style, [jobs[i] for i in part]), strict=True):
                out[i] = x
    return out  # type: ignore[return-value]


def _decode(width: int, height: int, style: int, jobs: list[tuple]) -> Iterable[np.ndarray]:
    n = len(jobs)
    planes = np.array([min(j[3], blocks.MOST_PLANES) for j in jobs])
    total = np.array([sum(s[0] for s in j[5]) for j in jobs])
    total = np.minimum(total, np.maximum(3 * planes - 2, 0))
    begins: dict[int, list[tuple[int, int, int]]] = {}  # first pass: lane, place, end
    held, place = [], 0
    for lane, j in enumerate(jobs):
        index = 0
        for passes, data in j[5]:
            raw = None
            for i in range(index, index + passes):  # a kind that changes inside a segment begins it again, as the scalar reader does
                if raw is None or blocks.is_raw(i, style) != raw:
                    begins.setdefault(i, []).append((lane, place, place + len(data)))
                    raw = blocks.is_raw(i, style)
            held.append(data)
            place += len(data)
            index += passes
    coder = Reading(n, np.frombuffer(b"".join(held) + b"\xff\xff", np.uint8))
    walk = _Walk(width, height, [j[2] for j in jobs], style, planes, coder)
    for index in range(int(total.max(initial=0))):
        on = total > index
        new = [x for x in begins.get(index, ()) if on[x[0]]]
        if new:
            lanes, at, stop = (np.array(x) for x in zip(*new, strict=True))
            coder.begin(lanes, at, stop, blocks.is_raw(index, style))
        walk.step(index, on)
    shape = height + 2, width + 2, n
    mag, last, neg = (x.reshape(shape)[1:-1, 1:-1] for x in (walk.mag, walk.last, walk.neg))
    whole = np.where(mag > 0, mag + ((np.int64(1) << last) >> 1), 0)
    whole = np.where(neg == 1, -whole, whole)
    return np.ascontiguousarray(np.moveaxis(whole, 2, 0))


def encode_blocks(values: list[tuple[np.ndarray, str]], style: int = 0) -> list[tuple[int, list[tuple[int, bytes]]]]:
    """(planes, [(passes, bytes) of each segment]) of each (coefficients, band), for writing files."""
    out: list[tuple[int, list[tuple[int, bytes]]]] = [(0, []) for _ in values]
    for (height, width), every in _grouped([v.shape for v, _ in values]).items():
        if not height * width:
            continue
        for k in range(0, len(every), LANES):
            part = every[k : k + LANES]
            for i, x in zip(part, _encode(width, height, style, [values[i] for i in part]), strict=True):
                out[i] = x
    return out


def _encode(width: int, height: int, style: int, values: list[tuple[np.ndarray, str]]) -> list[tuple[int, list[tuple[int, bytes]]]]:
    n = len(values)
    whole = np.zeros((height + 2, width + 2, n), np.int64)
    whole[1:-1, 1:-1] = np.stack([v for v, _ in values], axis=2)
    planes = np.array([int(np.abs(v).max()).bit_length() for v, _ in values])
    coder = Writing(n)
    walk = _Walk(width, height, [k for _, k in values], style, planes, coder)
    walk.value, walk.negative = np.abs(whole).reshape(-1, n), (whole < 0).reshape(-1, n).astype(np.uint8)
    total = np.maximum(3 * planes - 2, 0)
    done: list[list[tuple[int, bytes]]] = [[] for _ in range(n)]
    since, fresh_ = np.zeros(n, np.int64), np.ones(n, bool)
    for index in range(int(total.max(initial=0))):
        on, raw = total > index, blocks.is_raw(index, style)
        new = np.flatnonzero(on & fresh_)
        if len(new):
            coder.begin(new, raw)
            since[new], fresh_[new] = index, False
        walk.step(index, on)
        ends = on & ((total == index + 1) | blocks.ends_segment(index, style))
        lanes = np.flatnonzero(ends)
        if len(lanes):
            for i, b in zip(lanes.tolist(), coder.end(lanes, raw), strict=True):
                done[i].append((index + 1 - int(since[i]), b))
            fresh_[lanes] = True
    return [(int(p), d) for p, d in zip(planes, done, strict=True)]
