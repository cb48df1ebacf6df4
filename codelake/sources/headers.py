"""Containers, marker segments and tile-parts of one file: bytes in, plain records out. Errors carry file offsets."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

PROGRESSIONS = ("LRCP", "RLCP", "RPCL", "PCRL", "CPRL")
TRANSFORMS = ("9/7", "5/3")
QUANTISATIONS = ("none", "derived", "expounded")
COLOUR_SPACES = {16: "RGB", 17: "Grey", 18: "YCC"}
#: Fixed marker codes.
SOC, SIZ, COD, COC, QCD, QCC, RGN, SOT, SOD, EOC, SOP, EPH = 0xFF4F, 0xFF51, 0xFF52, 0xFF53, 0xFF5C, 0xFF5D, 0xFF5E, 0xFF90, 0xFF93, 0xFFD9, 0xFF91, 0xFF92
NAMES = {SOC: "SOC", SIZ: "SIZ", COD: "COD", COC: "COC", QCD: "QCD", QCC: "QCC", RGN: "RGN", SOT: "SOT", SOD: "SOD", EOC: "EOC", 0xFF64: "COM", 0xFF55: "TLM", 0xFF57: "PLM", 0xFF58: "PLT", 0xFF63: "CRG", 0xFF5F: "POC", 0xFF60: "PPM", 0xFF61: "PPT"}
IGNORED = frozenset([0xFF64, 0xFF55, 0xFF57, 0xFF58, 0xFF63])
#: Their packets stand in another order or lack headers; decoding without them would give wrong samples silently.
REFUSED = frozenset([0xFF5F, 0xFF60, 0xFF61])
MAX_TILES, MAX_SAMPLES, MAX_COEFFICIENTS = 65_536, 1 << 26, 1 << 26


class CodestreamError(Exception):
    """A refusal: kind, byte offset in the file, and a value some kinds carry."""

    def __init__(self, kind: str, offset: int = 0, value: int | None = None) -> None:
        super().__init__(f"at byte {offset}: {kind}" + ("" if value is None else f" ({value:#06x})" if kind in ("UnknownMarker", "UnsupportedMarker") else f" ({value})"))
        self.kind, self.offset, self.value = kind, offset, value


def repair(kind: str, **what: int) -> dict:
    say = ", ".join(f"{k} {v:#06x}" if k == "marker" else f"{k} {v}" for k, v in what.items())
    return {"kind": kind, **{k: what.get(k) for k in ("tile", "component", "declared", "found", "marker")}, "message": f"{kind}: {say}" if say else kind}


# --- containers


def walk_boxes(data: bytes, start: int = 0, stop: int | None = None, depth: int = 0) -> list[dict]:
    """Boxes in file order (only jp2h is entered); length 0 runs to the end, 1 has 64 bits; a bad size ends the walk."""
    stop = len(data) if stop is None else stop
    out: list[dict] = []
    at = start
    while depth < 8 and at + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > stop:
                break
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        end = stop if size == 0 else min(at + size, stop)
        if size and size < head:
            break
        out.append({"kind": kind.decode("latin-1"), "depth": depth, "start": at + head, "end": end})
        if kind == b"jp2h":
            out += walk_boxes(data, at + head, end, depth + 1)
        at = end
    return out


def _palette(b: bytes) -> list[list[int]]:
    if len(b) < 3:
        return []
    entries, channels = struct.unpack_from(">HB", b)
    depths = b[3 : 3 + channels]
    if len(depths) < channels:
        return []
    out, at = [], 3 + channels
    for _ in range(entries):
        row = []
        for d in depths:
            n = ((d & 0x7F) + 8) // 8
            if at + n > len(b):
                return out
            row.append(int.from_bytes(b[at : at + n], "big", signed=bool(d & 0x80)))
            at += n
        out.append(row)
    return out


def container(data: bytes) -> dict:
    """Codestream range (None if there is none), colour space, channel definitions, palette and component map."""
    out: dict = {"start": None, "end": None, "colour_space": None, "channel_definitions": [], "palette": [], "component_map": []}
    if data[:2] == b"\xff\x4f":
        return out | {"start": 0, "end": len(data)}
    for b in walk_boxes(data):
        body = data[b["start"] : b["end"]] if b["kind"] in ("colr", "cdef", "pclr", "cmap") else b""
        if b["kind"] == "jp2c" and out["start"] is None:
            out |= {"start": b["start"], "end": b["end"]}
        elif b["kind"] == "colr" and out["colour_space"] is None and len(body) >= 7 and body[0] == 1:
            code = struct.unpack_from(">I", body, 3)[0]
            out["colour_space"] = {"name": COLOUR_SPACES.get(code, "Other"), "code": code}
        elif b["kind"] == "cdef" and len(body) >= 2:
            n = min(struct.unpack_from(">H", body)[0], (len(body) - 2) // 6)
            out["channel_definitions"] = [dict(zip(("cn", "typ", "asoc"), struct.unpack_from(">HHH", body, 2 + 6 * i), strict=True)) for i in range(n)]
        elif b["kind"] == "pclr":
            out["palette"] = _palette(body)
        elif b["kind"] == "cmap":
            out["component_map"] = [dict(zip(("cmp", "mtyp", "pcol"), struct.unpack_from(">HBB", body, 4 * i), strict=True)) for i in range(len(body) // 4)]
    return out


def pdf_image_streams(data: bytes) -> list[bytes]:
    """The wavelet-coded image streams embedded in a document file: of every object whose dictionary names the filter,
    however deep its entries are nested, the bytes after ``stream``, by a direct /Length or else up to ``endstream``."""
    out = []
    for m in re.finditer(rb"/JPXDecode(?![A-Za-z0-9])", data):
        begin = data.rfind(b"obj", 0, m.start())
        head = re.compile(rb"stream(?:\r\n|\n|\r)|endobj").search(data, m.end())
        if begin < 0 or head is None or head[0] == b"endobj":
            continue
        size = re.search(rb"/Length\s+(\d+)(?!\d|\s+\d+\s+R)", data[begin : head.start()])
        stop = head.end() + int(size[1]) if size else data.find(b"endstream", head.end())
        body = data[head.end() : stop if stop >= 0 else len(data)]
        out.append(body if size else body.removesuffix(b"\n").removesuffix(b"\r"))
    return out


def unwrap(data: bytes) -> bytes:
    """The codestream of a container; anything without one is returned as it is."""
    where = container(data)
    return data if where["start"] is None else data[where["start"] : where["end"]]


# --- marker segments


class Reader:
    """Big-endian fields of one segment."""

    def __init__(self, data: bytes, at: int, stop: int) -> None:
        self.data, self.at, self.stop = data, at, stop

    def take(self, n: int) -> int:
        if self.at + n > self.stop:
            raise CodestreamError("UnexpectedEndOfCodestream", self.at)
        v = int.from_bytes(self.data[self.at : self.at + n], "big")
        self.at += n
        return v

    def all(self, kinds: str) -> tuple[int, ...]:
        """Fields of the kinds B, H and I at once; the first that does not fit is named as ``take`` would."""
        n = struct.calcsize(">" + kinds)
        if self.at + n > self.stop or self.at + n > len(self.data):
            return tuple(self.take({"B": 1, "H": 2, "I": 4}[k]) for k in kinds)
        v = struct.unpack_from(">" + kinds, self.data, self.at)
        self.at += n
        return v


@dataclass
class Blocks:
    levels: int = 5
    width: int = 6
    height: int = 6
    style: int = 0
    reversible: bool = True
    precincts: list[tuple[int, int]] = field(default_factory=list)

    def precinct(self, r: int) -> tuple[int, int]:
        return self.precincts[r] if r < len(self.precincts) else (15, 15)


@dataclass
class Steps:
    style: int = 0
    guard: int = 2
    steps: list[tuple[int, int]] = field(default_factory=list)  # exponent, mantissa


@dataclass
class Style:
    """Coding of one tile or, as default, of the image. Overrides win over defaults whatever their order."""

    progression: int | None = None
    layers: int = 1
    mct: bool = False
    sop: bool = False
    eph: bool = False
    cod: Blocks | None = None
    coc: dict[int, Blocks] = field(default_factory=dict)
    qcd: Steps | None = None
    qcc: dict[int, Steps] = field(default_factory=dict)
    rgn: dict[int, int] = field(default_factory=dict)
    base: Style | None = None

    def blocks(self, c: int) -> Blocks:
        up = self.base
        return self.coc.get(c) or self.cod or (up and (up.coc.get(c) or up.cod)) or Blocks()

    def steps(self, c: int) -> Steps:
        up = self.base
        return self.qcc.get(c) or self.qcd or (up and (up.qcc.get(c) or up.qcd)) or Steps()

    def shift(self, c: int) -> int:
        return self.rgn.get(c, self.base.rgn.get(c, 0) if self.base else 0)

    def order(self) -> Style:
        return self if self.progression is not None or self.base is None else self.base


def read_size(r: Reader) -> dict:
    offset = r.at
    keys = ("x1", "y1", "x0", "y0", "tile_width", "tile_height", "tile_x0", "tile_y0")
    _, *values, n = r.all("HIIIIIIIIH")
    h = dict(zip(keys, values, strict=True))
    if h["x1"] <= h["x0"] or h["y1"] <= h["y0"]:
        raise CodestreamError("EmptyImage", offset)
    if not n or not h["tile_width"] or not h["tile_height"] or h["tile_x0"] > h["x0"] or h["tile_y0"] > h["y0"] or h["tile_x0"] + h["tile_width"] <= h["x0"] or h["tile_y0"] + h["tile_height"] <= h["y0"]:
        raise CodestreamError("MalformedImageHeader", offset)
    h["components"] = []
    for _ in range(n):
        depth, dx, dy = r.all("BBB")
        if not dx or not dy:
            raise CodestreamError("MalformedImageHeader", offset)
        if (depth & 0x7F) + 1 > 31:
            raise CodestreamError("TooLarge", offset)
        h["components"].append({"depth": (depth & 0x7F) + 1, "signed": bool(depth & 0x80), "dx": dx, "dy": dy})
    h["tiles_wide"] = -(-(h["x1"] - h["tile_x0"]) // h["tile_width"])
    h["tiles_high"] = -(-(h["y1"] - h["tile_y0"]) // h["tile_height"])
    return h


def _blocks(r: Reader, own_precincts: bool, offset: int) -> Blocks:
    levels, w, h, style, transform = r.all("BBBBB")
    w, h = w + 2, h + 2
    if levels > 32:
        raise CodestreamError("TooLarge", offset)
    if w > 10 or h > 10 or w + h > 12:
        raise CodestreamError("MalformedMarkerSegment", offset)
    if transform > 1:
        raise CodestreamError("UnknownTransform", offset, transform)
    precincts = []
    for i in range(levels + 1 if own_precincts else 0):
        v = r.take(1)
        if i and not (v & 15 and v >> 4):
            raise CodestreamError("MalformedMarkerSegment", offset)
        precincts.append((v & 15, v >> 4))
    return Blocks(levels, w, h, style, transform == 1, precincts)


def _steps(r: Reader, offset: int) -> Steps:
    v = r.take(1)
    style, guard = v & 31, v >> 5
    if style > 2:
        raise CodestreamError("UnknownQuantisation", offset, style)
    steps = []
    while r.at < r.stop:
        each = r.all("B" * (r.stop - r.at)) if style == 0 else (r.take(2),)
        steps += [(x >> 3, 0) if style == 0 else (x >> 11, x & 0x7FF) for x in each]
    if not steps:
        raise CodestreamError("MalformedMarkerSegment", offset)
    return Steps(style, guard, steps)


def _component(r: Reader, n: int, offset: int) -> int:
    c = r.take(1 if n < 257 else 2)
    if c >= n:
        raise CodestreamError("ComponentIndexOutOfRange", offset, c)
    return c


def apply_segment(style: Style, marker: int, r: Reader, n: int, offset: int) -> None:
    if marker == COD:
        flags, progression, layers, mct = r.all("BBHB")
        if progression > 4:
            raise CodestreamError("UnknownProgression", offset, progression)
        if not layers:
            raise CodestreamError("MalformedMarkerSegment", offset)
        style.progression, style.layers, style.mct, style.sop, style.eph = progression, layers, bool(mct), bool(flags & 2), bool(flags & 4)
        style.cod = _blocks(r, bool(flags & 1), offset)
    elif marker == COC:
        c = _component(r, n, offset)
        style.coc[c] = _blocks(r, bool(r.take(1) & 1), offset)
    elif marker == QCD:
        style.qcd = _steps(r, offset)
    elif marker == QCC:
        c = _component(r, n, offset)
        style.qcc[c] = _steps(r, offset)
    elif marker == RGN:
        c = _component(r, n, offset)
        if r.take(1):
            raise CodestreamError("MalformedMarkerSegment", offset)
        style.rgn[c] = r.take(1)
    elif marker in REFUSED:
        raise CodestreamError("UnsupportedMarker", offset, marker)
    elif marker not in IGNORED:
        raise CodestreamError("UnknownMarker", offset, marker)


@dataclass
class Codestream:
    header: dict = field(default_factory=dict)
    style: Style = field(default_factory=Style)
    tiles: dict[int, Style] = field(default_factory=dict)
    parts: list[dict] = field(default_factory=list)
    repairs: list[dict] = field(default_factory=list)
    markers: list[dict] = field(default_factory=list)
    body: int = 0  # where the main header ends


def _segments(out: Codestream, style: Style, data: bytes, at: int, stop: int, ends: tuple[int, ...], permissive: bool, n: int) -> int:
    """Applies segments from ``at`` until a marker of ``ends``; returns that marker's place."""
    while True:
        if at + 2 > stop:
            raise CodestreamError("UnexpectedEndOfCodestream", at)
        marker = int.from_bytes(data[at : at + 2], "big")
        if marker in ends:
            return at
        if at + 4 > stop:
            raise CodestreamError("TruncatedMarkerSegment", at)
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > stop:
            raise CodestreamError("TruncatedMarkerSegment", at)
        out.markers.append({"marker": marker, "offset": at, "length": size})
        try:
            apply_segment(style, marker, Reader(data, at + 4, at + 2 + size), n, at)
        except CodestreamError as e:
            if not permissive or e.kind != "UnknownMarker":
                raise
            out.repairs.append(repair("UnknownMarkerSkipped", marker=marker))
        at += 2 + size


def parse(data: bytes, start: int, stop: int, permissive: bool = False) -> Codestream:
    """Main header, tile-parts and styles. Strict: rule breaks are errors. Permissive: what can be mended is listed."""
    out = Codestream()
    if data[start : start + 2] != b"\xff\x4f":
        raise CodestreamError("NotACodestream", start)
    at = start + 2
    out.markers.append({"marker": SOC, "offset": start, "length": 0})
    if data[at : at + 2] != b"\xff\x51":
        raise CodestreamError("MalformedImageHeader", at)
    size = int.from_bytes(data[at + 2 : at + 4], "big")
    if size < 2 or at + 2 + size > stop:
        raise CodestreamError("TruncatedMarkerSegment", at)
    out.markers.append({"marker": SIZ, "offset": at, "length": size})
    h = out.header = read_size(Reader(data, at + 4, at + 2 + size))
    n = len(h["components"])
    if h["tiles_wide"] * h["tiles_high"] > MAX_TILES or h["tiles_wide"] * h["tiles_high"] * n > 1 << 20:
        raise CodestreamError("TooLarge", at)
    at = _segments(out, out.style, data, at + 2 + size, stop, (SOT, EOC), permissive, n)
    out.body = at
    if not permissive and (out.style.cod is None or out.style.qcd is None):
        raise CodestreamError("MissingCodingStyle", at)
    ended, declared, found = False, {}, {}
    while at + 2 <= stop:
        marker = int.from_bytes(data[at : at + 2], "big")
        if marker == EOC:
            out.markers.append({"marker": EOC, "offset": at, "length": 0})
            ended = True
            break
        if marker != SOT:
            if permissive and out.parts:
                break
            raise CodestreamError("MisplacedTilePart", at)
        if at + 12 > stop or data[at + 2 : at + 4] != b"\x00\x0a":
            if permissive and out.parts:
                break
            raise CodestreamError("TruncatedMarkerSegment", at)
        tile, length, index, count = struct.unpack_from(">HIBB", data, at + 4)
        out.markers.append({"marker": SOT, "offset": at, "length": 10})
        if tile >= h["tiles_wide"] * h["tiles_high"]:
            raise CodestreamError("TileIndexOutOfRange", at, tile)
        end = at + length
        if length == 0:  # legal for the last tile-part: it runs to the end marker
            end = stop - 2 if data[stop - 2 : stop] == b"\xff\xd9" else stop
            if permissive and end == stop:
                out.repairs.append(repair("TilePartLengthUnstated", tile=tile))
        elif length < 14 or end > stop:
            if not permissive:
                raise CodestreamError("MalformedMarkerSegment" if length < 14 else "TruncatedMarkerSegment", at)
            out.repairs.append(repair("TilePartRunsPastTheEnd", tile=tile))
            end = stop
        style = out.tiles.setdefault(tile, Style(base=out.style))
        body = _segments(out, style, data, at + 12, end, (SOD,), permissive, n) + 2
        if count and not permissive and declared.get(tile, count) != count:
            raise CodestreamError("MalformedMarkerSegment", at)
        if count:
            declared[tile] = count
        found[tile] = found.get(tile, 0) + 1
        out.parts.append({"seq": len(out.parts), "tile": tile, "part_index": index, "declared": count, "start": body, "end": max(body, end), "sot": at})
        at = end
    if not ended:
        if not permissive:
            raise CodestreamError("UnexpectedEndOfCodestream", at)
        out.repairs.append(repair("EndOfCodestreamMissing"))
    for tile, count in sorted(declared.items()):
        if count != found[tile]:
            if not permissive:
                raise CodestreamError("MalformedMarkerSegment", next(p["sot"] for p in out.parts if p["tile"] == tile))
            out.repairs.append(repair("TilePartCountDisagrees", tile=tile, declared=count, found=found[tile]))
    out.parts.sort(key=lambda p: (p["tile"], p["part_index"], p["seq"]))
    return out


def write_part_counts(data: bytes) -> bytes:
    """The file with the true number of tile-parts in every tile-part header."""
    c = container(data)
    s = parse(data, c["start"], c["end"], permissive=True)
    out, found = bytearray(data), {}
    for p in s.parts:
        found[p["tile"]] = found.get(p["tile"], 0) + 1
    for p in s.parts:
        out[p["sot"] + 11] = min(found[p["tile"]], 255)
    return bytes(out)
