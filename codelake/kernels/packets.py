"""Packets of one tile: geometry, order, headers. The bytes of every code-block come out."""

from __future__ import annotations

from dataclasses import dataclass, field

from codelake.kernels.blocks import ends_segment
from codelake.sources.headers import CodestreamError, Style

OFFSETS = {"LL": (0, 0), "HL": (1, 0), "LH": (0, 1), "HH": (1, 1)}
GAIN = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}


def up(v: int, s: int) -> int:
    """v / 2**s rounded up."""
    return -(-v >> s)


class Bits:
    """Packet header bits: after a byte FF only seven; zeros past the end."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.byte, self.left, self.over = data, at, 0, 0, False

    def bit(self) -> int:
        if not self.left:
            self.left = 7 if self.byte == 0xFF else 8
            self.over |= self.at >= len(self.data)
            self.byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
        self.left -= 1
        return self.byte >> self.left & 1

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def align(self) -> int:
        if self.byte == 0xFF:  # a stuffed byte follows
            self.at += 1
        self.left = self.byte = 0
        return self.at


class Tree:
    """A tag tree: minima of leaves, read as far as a threshold asks."""

    def __init__(self, width: int, height: int) -> None:
        self.sizes = [(width, height)]
        while self.sizes[-1][0] * self.sizes[-1][1] > 1:
            w, h = self.sizes[-1]
            self.sizes.append(((w + 1) // 2, (h + 1) // 2))
        self.low = [[0] * (w * h) for w, h in self.sizes]
        self.known = [[False] * (w * h) for w, h in self.sizes]

    def read(self, x: int, y: int, limit: int, bits) -> int | None:
        """The leaf's value if it is below ``limit``; None if it is only known not to be."""
        floor = 0
        for k in range(len(self.sizes) - 1, -1, -1):
            i = (y >> k) * self.sizes[k][0] + (x >> k)
            self.low[k][i] = max(self.low[k][i], floor)
            while self.low[k][i] < limit and not self.known[k][i]:
                if bits.bit():
                    self.known[k][i] = True
                else:
                    self.low[k][i] += 1
            floor = self.low[k][i]
        return floor if self.known[0][y * self.sizes[0][0] + x] and floor < limit else None

    def value(self, x: int, y: int, bits, most: int = 64) -> int:
        v, limit = None, 1
        while v is None and limit <= most:
            v = self.read(x, y, limit, bits)
            limit += 1
        return most if v is None else v


def passes(bits: Bits) -> int:
    if not bits.bit():
        return 1
    if not bits.bit():
        return 2
    n = bits.take(2)
    if n < 3:
        return 3 + n
    n = bits.take(5)
    return 6 + n if n < 31 else 37 + bits.take(7)


@dataclass
class Block:
    rect: tuple[int, int, int, int]
    x: int
    y: int
    included: bool = False
    zero: int = 0
    lblock: int = 3
    passes: int = 0
    data: bytearray = field(default_factory=bytearray)
    pieces: list[tuple[int, int]] = field(default_factory=list)  # passes, length

    def segments(self, style: int) -> list[tuple[int, bytes]]:
        """Pieces joined across packets unless the coder was terminated between them."""
        out: list[list] = []
        at = index = 0
        for n, size in self.pieces:
            if out and not ends_segment(index - 1, style):
                out[-1][0] += n
                out[-1][1] += bytes(self.data[at : at + size])
            else:
                out.append([n, bytes(self.data[at : at + size])])
            at += size
            index += n
        return [(n, b) for n, b in out]


@dataclass
class Precinct:
    blocks: list[Block]
    inclusion: Tree | None
    zeros: Tree | None


@dataclass
class Band:
    name: str
    rect: tuple[int, int, int, int]
    exponent: int
    mantissa: int
    planes: int
    precincts: list[Precinct]


@dataclass
class Resolution:
    rect: tuple[int, int, int, int]
    ppx: int
    ppy: int
    wide: int
    high: int
    bands: list[Band]


def build_component(rect: tuple[int, int, int, int], style: Style, c: int, dx: int, dy: int, strict: bool, most: int, coded: bool = True) -> list[Resolution]:
    """Unless ``coded``, no packets follow, and the bands are made without their precincts and blocks."""
    b, q = style.blocks(c), style.steps(c)
    x0, y0, x1, y1 = -(-rect[0] // dx), -(-rect[1] // dy), -(-rect[2] // dx), -(-rect[3] // dy)
    if (x1 - x0) * (y1 - y0) > most:
        raise CodestreamError("TooLarge")
    out = []
    for r in range(b.levels + 1):
        s = b.levels - r
        rx0, ry0, rx1, ry1 = up(x0, s), up(y0, s), up(x1, s), up(y1, s)
        ppx, ppy = b.precinct(r)
        wide = up(rx1, ppx) - (rx0 >> ppx) if rx1 > rx0 else 0
        high = up(ry1, ppy) - (ry0 >> ppy) if ry1 > ry0 else 0
        bands = []
        for k, name in enumerate(("LL",) if not r else ("HL", "LH", "HH")):
            n = s + (r > 0)
            ox, oy = OFFSETS[name]
            half = 1 << n >> 1
            bx0, by0, bx1, by1 = (max(0, up(v - half * o, n)) for v, o in ((x0, ox), (y0, oy), (x1, ox), (y1, oy)))
            at = 3 * (r - 1) + k + 1 if r else 0
            steps = q.steps or [(0, 0)]
            if q.style == 1:
                exponent, mantissa = steps[0][0] - (max(r - 1, 0)), steps[0][1]
            else:
                if at >= len(steps) and strict and q.steps:
                    raise CodestreamError("MalformedMarkerSegment")
                exponent, mantissa = steps[min(at, len(steps) - 1)]
            planes = max(q.guard + exponent - 1, 0) + style.shift(c)
            cut = int(r > 0)
            px, py = ppx - cut, ppy - cut
            cw, ch = min(b.width, px), min(b.height, py)
            precincts = []
            for j in range(high if coded else 0):
                for i in range(wide):
                    qx0, qy0 = max(((rx0 >> ppx) + i) << px, bx0), max(((ry0 >> ppy) + j) << py, by0)
                    qx1, qy1 = min(((rx0 >> ppx) + i + 1) << px, bx1), min(((ry0 >> ppy) + j + 1) << py, by1)
                    if qx1 <= qx0 or qy1 <= qy0:
                        precincts.append(Precinct([], None, None))
                        continue
                    gx0, gy0, gx1, gy1 = qx0 >> cw, qy0 >> ch, up(qx1, cw), up(qy1, ch)
                    blocks = [Block((max(u << cw, qx0), max(v << ch, qy0), min((u + 1) << cw, qx1), min((v + 1) << ch, qy1)), u - gx0, v - gy0) for v in range(gy0, gy1) for u in range(gx0, gx1)]
                    precincts.append(Precinct(blocks, Tree(gx1 - gx0, gy1 - gy0), Tree(gx1 - gx0, gy1 - gy0)))
            bands.append(Band(name, (bx0, by0, bx1, by1), exponent, mantissa, planes, precincts))
        out.append(Resolution((rx0, ry0, rx1, ry1), ppx, ppy, wide, high, bands))
    return out


def packet_order(components: list[list[Resolution]], sampling: list[tuple[int, int]], progression: int, layers: int, tile: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """(layer, resolution, component, precinct) of all packets. Positions are clamped to the tile's edge."""
    cells = []
    for c, (resolutions, (dx, dy)) in enumerate(zip(components, sampling, strict=True)):
        for r, res in enumerate(resolutions):
            s = len(resolutions) - 1 - r
            for p in range(res.wide * res.high):
                x = max((((res.rect[0] >> res.ppx) + p % res.wide) << (res.ppx + s)) * dx, tile[0])
                y = max((((res.rect[1] >> res.ppy) + p // res.wide) << (res.ppy + s)) * dy, tile[1])
                cells.append((r, c, p, x, y))
    if progression < 2:
        keys = [(la, r, c, p) for r, c, p, _, _ in cells for la in range(layers)]
        return sorted(keys, key=(lambda k: k) if not progression else (lambda k: (k[1], k[0], k[2], k[3])))
    key = {2: lambda z: (z[0], z[4], z[3], z[1], z[2]), 3: lambda z: (z[4], z[3], z[1], z[0], z[2]), 4: lambda z: (z[1], z[4], z[3], z[0], z[2])}[progression]
    return [(la, r, c, p) for r, c, p, _, _ in sorted(cells, key=key) for la in range(layers)]


def read_packets(data: bytes, components: list[list[Resolution]], order: list[tuple[int, int, int, int]], style: Style) -> bool:
    """Reads all packets into the blocks; False if they run past the data."""
    at, main = 0, style.order()
    for layer, r, c, p in order:
        if at >= len(data):
            return True
        if data[at : at + 2] == b"\xff\x91":
            at += 6
        bits = Bits(data, at)
        todo: list[tuple[Block, list[tuple[int, int]]]] = []
        code = style.blocks(c).style
        if bits.bit():
            for band in components[c][r].bands:
                pre = band.precincts[p]
                for b in pre.blocks:
                    if b.included:
                        if not bits.bit():
                            continue
                    else:
                        if pre.inclusion.read(b.x, b.y, layer + 1, bits) is None:
                            continue
                        b.included = True
                        b.zero = pre.zeros.value(b.x, b.y, bits)
                    n = passes(bits)
                    while bits.bit() and b.lblock < 64:
                        b.lblock += 1
                    pieces = []
                    while n:
                        run = 1
                        while run < n and not ends_segment(b.passes + run - 1, code):
                            run += 1
                        pieces.append((run, bits.take(b.lblock + run.bit_length() - 1)))
                        b.passes += run
                        n -= run
                    todo.append((b, pieces))
        at = bits.align()
        if data[at : at + 2] == b"\xff\x92" and main.eph:
            at += 2
        for b, pieces in todo:
            for n, size in pieces:
                b.data += data[at : at + size]
                b.pieces.append((n, min(size, max(0, len(data) - at))))
                at += size
        if bits.over or at > len(data):
            return False
    return True
