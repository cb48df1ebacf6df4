"""A writer of codestreams for round trips and fixtures: both filters, layers, tile-parts, block styles, overrides."""

from __future__ import annotations

import struct
from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np

from codelake.kernels import blocks, lanes, wavelet
from codelake.kernels.packets import GAIN, Tree, build_component, packet_order
from codelake.sources.headers import Blocks, Steps, Style


class _Bits:
    def __init__(self) -> None:
        self.out, self.now, self.left = bytearray(), 0, 8

    def put(self, v: int, n: int = 1) -> None:
        for i in range(n - 1, -1, -1):
            self.left -= 1
            self.now |= (v >> i & 1) << self.left
            if not self.left:
                self.out.append(self.now)
                self.left, self.now = (7 if self.now == 0xFF else 8), 0

    def end(self) -> bytes:
        if self.left < (7 if self.out[-1:] == b"\xff" else 8):
            self.out.append(self.now)
        if self.out[-1:] == b"\xff":
            self.out.append(0)
        return bytes(self.out)


class _Told:
    """Answers a tag tree's questions from known values and writes the answers."""

    def __init__(self, bits: _Bits, width: int, height: int, leaves: dict[tuple[int, int], int]) -> None:
        self.bits, self.tree = bits, Tree(width, height)
        self.value = []
        for k in range(len(self.tree.sizes)):
            low: dict[tuple[int, int], int] = {}
            for (x, y), v in leaves.items():
                low[x >> k, y >> k] = min(v, low.get((x >> k, y >> k), v))
            self.value.append(low)

    def tell(self, x: int, y: int, limit: int) -> None:
        floor, t = 0, self.tree
        for k in range(len(t.sizes) - 1, -1, -1):
            i, v = (y >> k) * t.sizes[k][0] + (x >> k), self.value[k][x >> k, y >> k]
            t.low[k][i] = max(t.low[k][i], floor)
            while t.low[k][i] < limit and not t.known[k][i]:
                yes = v <= t.low[k][i]
                self.bits.put(int(yes))
                if yes:
                    t.known[k][i] = True
                else:
                    t.low[k][i] += 1
            floor = t.low[k][i]


def _passes(bits: _Bits, n: int) -> None:
    if n == 1:
        bits.put(0)
    elif n == 2:
        bits.put(2, 2)
    elif n < 6:
        bits.put(12 | n - 3, 4)
    elif n < 37:
        bits.put(480 | n - 6, 9)
    else:
        bits.put(0x1FF << 7 | n - 37, 16)


@dataclass
class _Coded:
    """A block that is being written: its passes' segments, and how many passes and bytes are in the packets so far."""

    planes: int
    segments: list[tuple[int, bytes]]
    total: int = 0
    sent: int = 0
    lblock: int = 3
    first: int = 0  # layer it first appears in
    pieces: list[list[tuple[int, bytes]]] = field(default_factory=list)  # per layer

    def deal(self, layers: int, style: int) -> None:
        """About the same number of passes for every layer; a segment that is cut is cut in its bytes as well."""
        self.total = sum(n for n, _ in self.segments)
        ends = [self.total * (i + 1) // layers for i in range(layers)]
        self.pieces = [[] for _ in range(layers)]
        at = 0
        for n, data in self.segments:
            done = 0
            for i, end in enumerate(ends):
                take = min(at + n, end) - max(at, ends[i - 1] if i else 0)
                if take > 0:
                    to = len(data) if at + n <= end else len(data) * (max(at, ends[i - 1] if i else 0) + take - at) // n
                    self.pieces[i].append((take, data[done:to]))
                    done = to
            at += n
        self.first = next((i for i, p in enumerate(self.pieces) if p), layers)


def _exponents(depth: int, mct: bool, blocks_: Blocks, step: float | None) -> list[tuple[int, int]]:
    """(exponent, mantissa) of every band: plain bit growth, or steps near ``step`` times the band's gain."""
    names = ["LL", *(["HL", "LH", "HH"] * blocks_.levels)]
    if blocks_.reversible:
        return [(depth + int(mct) + GAIN[n], 0) for n in names]
    e = depth - int(np.floor(np.log2(step or 1 / 16)))
    return [(e + GAIN[n], 512 + 64 * i) for i, n in enumerate(names)]


def _qcd(style: int, guard: int, steps: list[tuple[int, int]]) -> bytes:
    told = steps[:1] if style == 1 else steps
    return bytes([style | guard << 5]) + b"".join(bytes([e << 3]) if not style else struct.pack(">H", e << 11 | m) for e, m in told)


def _cod_body(b: Blocks) -> bytes:
    return bytes([b.levels, b.width - 2, b.height - 2, b.style, int(b.reversible)]) + bytes(x | y << 4 for x, y in b.precincts)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">HH", marker, len(body) + 2) + body


Segments = list[tuple[int, bytes]]
#: A writer asks for blocks, (coefficients, band) of one style, to be coded, and gets (planes, segments) of each.
Writer = Generator[tuple[list[tuple[np.ndarray, str]], int], list[tuple[int, Segments]], bytes]


def encode_image(planes: list[np.ndarray], depth: int = 8, **options) -> bytes:
    """A bare codestream of integer planes; the options are those of ``writer``."""
    return encode_images([(planes, {"depth": depth, **options})])[0]


def encode_images(pictures: list[tuple[list[np.ndarray], dict]]) -> list[bytes]:
    """Codestreams of many pictures (planes, options of ``writer``), whose blocks are coded together."""
    writers = [writer(planes, **options) for planes, options in pictures]
    out: dict[int, bytes] = {}
    asked = {i: next(w) for i, w in enumerate(writers)}
    while asked:
        done: dict[int, list[tuple[int, Segments]]] = {}
        for style in {style for _, style in asked.values()}:
            some = [i for i, (_, s) in asked.items() if s == style]
            values = [v for i in some for v in asked[i][0]]
            coded = iter(lanes.encode_blocks(values, style) if style or len(values) >= MANY else [(m, [(n, raw)] if n else []) for m, n, raw in (blocks.encode(*v) for v in values)])
            done |= {i: [next(coded) for _ in asked[i][0]] for i in some}
        asked = {}
        for i, found in done.items():
            try:
                asked[i] = writers[i].send(found)
            except StopIteration as end:
                out[i] = end.value
    return [out[i] for i in range(len(writers))]


MANY = 256  # blocks from which lanes are faster than one block after the other


def writer(
    planes: list[np.ndarray], depth: int = 8, levels: int = 2, tile: int | None = None, progression: int = 0, mct: bool = False, precincts: int | None = None, eph: bool = False, declared: int | None = None, signed: bool = False,
    *, lossy: float | None = None, quantisation: int | None = None, layers: int = 1, parts: int = 1, style: int = 0, block: tuple[int, int] = (6, 6), sampling: list[tuple[int, int]] | None = None, size: tuple[int, int] | None = None, origin: tuple[int, int] = (0, 0), sop: bool = False,
    component_levels: dict[int, int] | None = None, tile_levels: dict[int, int] | None = None, roi: dict[int, int] | None = None,
) -> Writer:
    """The writer of one codestream of integer planes.

    ``lossy``: 9/7 with about this step (``quantisation`` 1 derived, 2 expounded); else 5/3. ``layers`` share the passes
    of every block, ``parts`` the packets of every tile, dealt out in turns over the tiles. ``sampling``: (dx, dy) of
    each component, whose plane then has the size of its part of the reference grid (``size``, from ``origin`` on).
    ``component_levels``: levels by COC and QCC; ``tile_levels``: levels of a tile by COD and QCD in its header; ``roi``:
    shift by RGN, with the coefficients at even places as the region.
    """
    n = len(planes)
    sampling, roi = sampling or [(1, 1)] * n, roi or {}
    h, w = size or planes[0].shape
    x0, y0 = origin
    x1, y1 = x0 + w, y0 + h
    tw, th = (tile or x1), (tile or y1)
    reversible, guard = lossy is None, 2
    kind = 0 if reversible else quantisation or 2

    def blocks_of(levels_: int) -> Blocks:
        return Blocks(levels_, *block, style, reversible, [(precincts, precincts)] * (levels_ + 1) if precincts else [])

    def steps_of(b: Blocks) -> Steps:
        e = _exponents(depth, mct, b, lossy)
        return Steps(kind, guard, [(e[0][0] + b.levels, e[0][1])] if kind == 1 else e)

    main = Style(progression=progression, layers=layers, mct=mct, sop=sop, eph=eph, cod=(cod := blocks_of(levels)), qcd=steps_of(cod), rgn=dict(roi))
    for c, k in (component_levels or {}).items():
        main.coc[c], main.qcc[c] = (b := blocks_of(k)), steps_of(b)
    flags = bool(precincts) | sop << 1 | eph << 2
    index = ">B" if n < 257 else ">H"
    cod_segment = lambda b: _segment(0xFF52, bytes([flags, progression, layers >> 8, layers & 255, int(mct)]) + _cod_body(b))
    out = bytearray(b"\xff\x4f" + _segment(0xFF51, struct.pack(">HIIIIIIIIH", 0, x1, y1, x0, y0, tw, th, 0, 0, n) + b"".join(bytes([depth - 1 | signed << 7, dx, dy]) for dx, dy in sampling)))
    out += cod_segment(cod) + _segment(0xFF5C, _qcd(kind, guard, main.qcd.steps))
    for c, b in main.coc.items():
        out += _segment(0xFF53, struct.pack(index, c) + bytes([bool(precincts)]) + _cod_body(b)) + _segment(0xFF5D, struct.pack(index, c) + _qcd(kind, guard, main.qcc[c].steps))
    for c, shift in roi.items():
        out += _segment(0xFF5E, struct.pack(index, c) + bytes([0, shift]))
    wide = -(-x1 // tw)
    told: list[tuple[int, int, bytes]] = []  # part, tile, bytes
    for t in range(wide * -(-y1 // th)):
        rect = max(t % wide * tw, x0), max(t // wide * th, y0), min(t % wide * tw + tw, x1), min(t // wide * th + th, y1)
        if rect[2] <= rect[0] or rect[3] <= rect[1]:
            told.append((0, t, b""))
            continue
        own, head = main, b""
        if t in (tile_levels or {}):
            own = Style(progression=progression, layers=layers, mct=mct, sop=sop, eph=eph, cod=(b := blocks_of(tile_levels[t])), qcd=steps_of(b), base=main)
            head = cod_segment(b) + _segment(0xFF5C, _qcd(kind, guard, own.qcd.steps))
        packets = yield from _tile_packets(planes, rect, origin, sampling, depth, signed, own, progression, layers, mct, lossy)
        for i in range(parts):
            told.append((i, t, (head if not i else b"") + b"\xff\x93" + b"".join(packets[len(packets) * i // parts : len(packets) * (i + 1) // parts])))
    for i, t, body in sorted(told, key=lambda x: x[:2]):
        if body:
            out += b"\xff\x90" + struct.pack(">HHIBB", 10, t, 12 + len(body), i, parts if declared is None else declared) + body
    return bytes(out + b"\xff\xd9")


def _tile_packets(planes: list[np.ndarray], rect: tuple[int, int, int, int], origin: tuple[int, int], sampling: list[tuple[int, int]], depth: int, signed: bool, style: Style, progression: int, layers: int, mct: bool, lossy: float | None) -> Generator[tuple[list[tuple[np.ndarray, str]], int], list[tuple[int, Segments]], list[bytes]]:
    part = []
    for p, (dx, dy) in zip(planes, sampling, strict=True):
        u, v = -(-origin[0] // dx), -(-origin[1] // dy)
        part.append(p[-(-rect[1] // dy) - v : -(-rect[3] // dy) - v, -(-rect[0] // dx) - u : -(-rect[2] // dx) - u].astype(np.int64) - (0 if signed else 1 << (depth - 1)))
    if mct:
        r, g, b = part[:3]
        if lossy is None:
            part[:3] = (r + 2 * g + b) >> 2, b - g, r - g
        else:
            y = 0.299 * r + 0.587 * g + 0.114 * b
            part[:3] = y, (b - y) / 1.772, (r - y) / 1.402
    tree = [build_component(rect, style, c, *sampling[c], True, 1 << 26) for c in range(len(part))]
    places, values = [], []
    for c, p in enumerate(part):
        bands = wavelet.analyse(p, -(-rect[0] // sampling[c][0]), -(-rect[1] // sampling[c][1]), style.blocks(c).levels, lossy is None)
        for r, res in enumerate(tree[c]):
            for band in res.bands:
                x = bands[r][band.name]
                if lossy is not None:
                    step = 2.0 ** (depth + GAIN[band.name] - band.exponent) * (1 + band.mantissa / 2048)
                    x = (np.sign(x) * np.floor(np.abs(x) / step)).astype(np.int64)
                if style.shift(c):
                    inside = (np.add.outer(np.arange(x.shape[0]), np.arange(x.shape[1])) % 2) == 0
                    x = np.where(inside, x << style.shift(c), x)
                for pre in band.precincts:
                    for k in pre.blocks:
                        u0, v0, u1, v1 = k.rect
                        places.append((id(k), c))
                        values.append((x[v0 - band.rect[1] : v1 - band.rect[1], u0 - band.rect[0] : u1 - band.rect[0]], band.name))
    coded: dict[int, _Coded] = {}
    code = style.blocks(0).style
    found = yield values, code
    for (k, _), (count, segments) in zip(places, found, strict=True):
        coded[k] = _Coded(count, segments)
        coded[k].deal(layers, code)
    told: dict[int, tuple[_Told, _Told]] = {}
    out: list[bytes] = []
    for layer, r, c, p in packet_order(tree, sampling, progression, layers, rect[:2]):
        bits, data = _Bits(), bytearray()
        bits.put(1)
        for band in tree[c][r].bands:
            pre = band.precincts[p]
            if not pre.blocks:
                continue
            if id(pre) not in told:
                size = pre.inclusion.sizes[0]
                told[id(pre)] = tuple(_Told(bits, *size, {(k.x, k.y): v(coded[id(k)]) for k in pre.blocks}) for v in (lambda x: x.first, lambda x, b=band: b.planes - x.planes))
            inclusion, zeros = told[id(pre)]
            inclusion.bits = zeros.bits = bits
            for k in pre.blocks:
                x = coded[id(k)]
                pieces = x.pieces[layer]
                if x.sent:
                    bits.put(int(bool(pieces)))
                else:
                    inclusion.tell(k.x, k.y, layer + 1)
                    if pieces:
                        for limit in range(1, band.planes - x.planes + 2):
                            zeros.tell(k.x, k.y, limit)
                if not pieces:
                    continue
                _passes(bits, sum(m for m, _ in pieces))
                room = [max(0, len(raw).bit_length() - (x.lblock + m.bit_length() - 1)) for m, raw in pieces]
                more = max(room)
                bits.put((1 << more + 1) - 2, more + 1)
                x.lblock += more
                for m, raw in pieces:
                    bits.put(len(raw), x.lblock + m.bit_length() - 1)
                    data += raw
                    x.sent += m
        out.append((b"\xff\x91" + struct.pack(">HH", 4, len(out) & 0xFFFF) if style.sop else b"") + bits.end() + (b"\xff\x92" if style.eph else b"") + data)
    return out


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def wrap(codestream: bytes, colour: int = 17) -> bytes:
    """The codestream in a minimal container."""
    header = box(b"ihdr", bytes(14)) + box(b"colr", bytes([1, 0, 0]) + struct.pack(">I", colour))
    return box(b"jP  ", b"\r\n\x87\n") + box(b"ftyp", b"jp2 \0\0\0\0jp2 ") + box(b"jp2h", header) + box(b"jp2c", codestream)


def header_only(width: int, height: int, components: int = 1, levels: int = 5, progression: int = 1, layers: int = 3, tile: int = 8, parts: tuple[int, ...] | None = None, declared: int | None = None, mct: bool = True, turns: bool = False, component_levels: dict[int, int] | None = None, tile_levels: dict[int, int] | None = None) -> bytes:
    """A codestream of headers and empty tile-parts, for inventories: 8-bit unsigned, 64x64 blocks, reversible.

    ``turns``: the tiles' last parts come first, in turns over the tiles. ``component_levels``: levels by COC and QCC of
    the main header; ``tile_levels``: by COD and QCD of a tile's first part."""
    steps = lambda k: bytes([8 << 3]) * (3 * k + 1)
    cod = lambda k: _segment(0xFF52, struct.pack(">BBHBBBBBB", 0, progression, layers, mct, k, 4, 4, 0, 1)) + _segment(0xFF5C, bytes([2 << 5]) + steps(k))
    out = bytearray(b"\xff\x4f" + _segment(0xFF51, struct.pack(">HIIIIIIIIH", 0, width, height, 0, 0, tile, tile, 0, 0, components) + bytes([7, 1, 1]) * components) + cod(levels))
    for c, k in (component_levels or {}).items():
        out += _segment(0xFF53, bytes([c, 0, k, 4, 4, 0, 1])) + _segment(0xFF5D, bytes([c, 2 << 5]) + steps(k))
    counts = parts or (1,) * (-(-width // tile) * -(-height // tile))
    listed = [(t, i, n) for t, n in enumerate(counts) for i in range(n)]
    for t, i, n in sorted(listed, key=lambda x: (-x[1], x[0])) if turns else listed:
        own = cod(tile_levels[t]) if t in (tile_levels or {}) and not i else b""
        out += b"\xff\x90" + struct.pack(">HHIBB", 10, t, 14 + len(own), i, n if declared is None else declared) + own + b"\xff\x93"
    return bytes(out + b"\xff\xd9")


def golden_picture(width: int = 20, height: int = 14, channels: int = 3) -> list[np.ndarray]:
    """The formula-defined test picture: ramps and products with noise of a linear congruential generator."""
    state, planes = 99, [np.zeros((height, width), np.int64) for _ in range(channels)]
    for y in range(height):
        for x in range(width):
            state = (state * 1103515245 + 12345) & 0xFFFFFFFF
            noise = state >> 21 & 63
            for plane, v in zip(planes, (17 * x + 5 * y, x * x + 11 * y, 9 * (x ^ y)), strict=False):
                plane[y, x] = (v + noise) & 255
    return planes
