"""Files to sample planes: the functions that ``decode`` runs inside Spark's workers.

A file is opened (headers, packets), its code-blocks become jobs, and the jobs of many files and tiles are decoded
together: blocks of one shape in lanes, see ``kernels.lanes``. Then planes are put together from the results.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from codelake.kernels import blocks, lanes, packets, wavelet
from codelake.sources import headers
from codelake.sources.headers import CodestreamError, repair

#: What damaged bytes may raise where no rule of the format names the damage.
DAMAGE = (IndexError, ValueError, OverflowError, MemoryError, KeyError, struct.error)
#: Blocks of one shape from which lanes are faster than one block after the other, on a few thousand cells.
MANY = 192
#: Coefficients of the files that are decoded together (a larger file is alone).
TOGETHER = 1 << 20


def error(e: Exception) -> dict:
    if isinstance(e, CodestreamError):
        return {"offset": e.offset, "kind": e.kind, "value": e.value, "message": str(e)}
    return {"offset": 0, "kind": "Damaged", "value": None, "message": f"{type(e).__name__}: {e}"}


def round_away(x: np.ndarray) -> np.ndarray:
    """Half away from zero, in single precision."""
    t = np.trunc(x)
    return (t + np.where(np.abs(x - t) >= np.float32(0.5), np.sign(x), 0)).astype(np.int64)


def inverse_rct(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = y - ((u + v) >> 2)
    return v + g, g, u + g


def inverse_ict(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, c, d = (np.float32(k) for k in (1.402, 0.344136, 0.714136, 1.772))
    return y + a * cr, y - b * cb - c * cr, y + d * cb


def finish(plane: np.ndarray, depth: int, signed: bool) -> np.ndarray:
    """Rounding, level shift and clamping to the component's range."""
    x = plane if plane.dtype == np.int64 else round_away(plane)
    low = -(1 << (depth - 1)) if signed else 0
    return np.minimum(np.maximum(x if signed else x + (1 << (depth - 1)), low), low + (1 << depth) - 1)


def tile_rect(h: dict, t: int) -> tuple[int, int, int, int]:
    c, r = t % h["tiles_wide"], t // h["tiles_wide"]
    x, y = h["tile_x0"] + c * h["tile_width"], h["tile_y0"] + r * h["tile_height"]
    return max(x, h["x0"]), max(y, h["y0"]), min(x + h["tile_width"], h["x1"]), min(y + h["tile_height"], h["y1"])


@dataclass
class Tile:
    """An opened tile: what its packets hold, before any coefficient is decoded."""

    header: dict
    style: headers.Style
    number: int
    strict: bool
    repairs: list[dict]
    tree: list[list[packets.Resolution]]
    jobs: list[tuple] = field(default_factory=list)

    @classmethod
    def open(cls, data: bytes, stream: headers.Codestream, t: int, strict: bool, most: int, repairs: list[dict]) -> Tile:
        h, rect = stream.header, tile_rect(stream.header, t)
        style = stream.tiles.get(t, headers.Style(base=stream.style))
        specs = h["components"]
        parts = [p for p in stream.parts if p["tile"] == t]
        body = b"".join(data[p["start"] : p["end"]] for p in parts)
        tree = [packets.build_component(rect, style, c, s["dx"], s["dy"], strict, most, bool(body)) for c, s in enumerate(specs)]
        if not parts:
            if strict:
                raise CodestreamError("UnexpectedEndOfCodestream")
            repairs.append(repair("TileMissing", tile=t))
        if body:
            main = style.order()
            order = packets.packet_order(tree, [(s["dx"], s["dy"]) for s in specs], main.progression or 0, main.layers, rect[:2])
            if not packets.read_packets(body, tree, order, style):
                if strict:
                    raise CodestreamError("UnexpectedEndOfCodestream")
                repairs.append(repair("PacketsRunPastTheirTile", tile=t))
        out = cls(h, style, t, strict, repairs, tree)
        out.jobs = [(k.rect[2] - k.rect[0], k.rect[3] - k.rect[1], band.name, max(band.planes - k.zero, 0), style.blocks(c).style, k.segments(style.blocks(c).style)) for c, band, k in out.blocks()]
        return out

    def blocks(self) -> Iterator[tuple[int, packets.Band, packets.Block]]:
        for c, resolutions in enumerate(self.tree):
            for res in resolutions:
                for band in res.bands:
                    for p in band.precincts:
                        for k in p.blocks:
                            if k.passes:
                                yield c, band, k

    def planes(self, found: Iterable[np.ndarray]) -> list[np.ndarray]:
        """Planes of the tile's components before level shift, from the coefficients of its jobs."""
        coded = {c for c, _, _ in self.blocks()}
        bands = {id(band): np.zeros((max(0, band.rect[3] - band.rect[1]), max(0, band.rect[2] - band.rect[0])), np.int64) for c in coded for r in self.tree[c] for band in r.bands}
        damaged = set()
        for (c, band, k), x in zip(self.blocks(), found, strict=True):
            u0, v0, u1, v1 = k.rect
            n, roi = band.planes - k.zero, self.style.shift(c)
            if n <= 0 or n > blocks.MOST_PLANES or k.passes > 3 * n - 2:
                damaged.add(c)
            if roi:  # background coefficients are those below 2**roi
                m = np.abs(x)
                x = np.sign(x) * np.where(m >= 1 << roi, m >> roi, m)
            bands[id(band)][v0 - band.rect[1] : v1 - band.rect[1], u0 - band.rect[0] : u1 - band.rect[0]] = x
        planes = []
        for c, s in enumerate(self.header["components"]):
            b, q = self.style.blocks(c), self.style.steps(c)
            if c in damaged:
                if self.strict:
                    raise CodestreamError("MalformedMarkerSegment")
                self.repairs.append(repair("CodeBlockDamaged", tile=self.number, component=c))
            if c not in coded:  # both filters turn zeros into zeros
                x0, y0, x1, y1 = self.tree[c][-1].rect
                planes.append(np.zeros((y1 - y0, x1 - x0), np.int64 if b.reversible else np.float32))
                continue
            levels = []
            for res in self.tree[c]:
                each = {}
                for band in res.bands:
                    out = bands[id(band)]
                    if not b.reversible:
                        step = np.float32(1) if q.style == 0 else np.float32(2.0 ** (s["depth"] + packets.GAIN[band.name] - band.exponent)) * (np.float32(1) + np.float32(band.mantissa) / np.float32(2048))
                        out = out.astype(np.float32) * step
                    each[band.name] = out
                levels.append((res.rect, each))
            planes.append(wavelet.synthesise(levels, b.reversible))
        if self.style.order().mct and len(planes) >= 3:
            kinds = {self.style.blocks(c).reversible for c in range(3)}
            if len(kinds) > 1 or len({p.shape for p in planes[:3]}) > 1:
                raise CodestreamError("MalformedMarkerSegment")
            planes[:3] = (inverse_rct if kinds.pop() else inverse_ict)(*planes[:3])
        return planes


def decode_jobs(jobs: list[tuple]) -> list[np.ndarray]:
    """Coefficients of all jobs: shapes that occur often in lanes, the others one by one."""
    often: dict[tuple, list[int]] = {}
    for i, j in enumerate(jobs):
        often.setdefault((j[0], j[1], j[4]), []).append(i)
    at = [i for every in often.values() if len(every) >= MANY for i in every]
    out = dict(zip(at, lanes.decode_blocks([jobs[i] for i in at]), strict=True))
    return [out[i] if i in out else blocks.decode(*j) for i, j in enumerate(jobs)]


class File:
    """A file on its way: opened, with its tiles' jobs, and then finished. Errors end it and are kept."""

    def __init__(self, data: bytes, permissive: bool, max_samples: int, max_coefficients: int, tiles: list[int] | None) -> None:
        self.out: dict = {"width": None, "height": None, "components": None, "repairs": [], "error": None, "colour_space": None, "channel_definitions": [], "palette": [], "component_map": []}
        self.tiles: list[Tile] = []
        try:
            where = headers.container(data or b"")
            self.out |= {k: where[k] for k in ("colour_space", "channel_definitions", "palette", "component_map")}
            if where["start"] is None:
                raise CodestreamError("NotACodestream")
            s = headers.parse(data, where["start"], where["end"], permissive)
            h = self.header = s.header
            specs = h["components"]
            self.rects = [(-(-h["x0"] // c["dx"]), -(-h["y0"] // c["dy"]), -(-h["x1"] // c["dx"]), -(-h["y1"] // c["dy"])) for c in specs]
            if sum((r[2] - r[0]) * (r[3] - r[1]) for r in self.rects) > max_samples:
                raise CodestreamError("TooLarge")
            if any(r[2] <= r[0] or r[3] <= r[1] for r in self.rects):
                raise CodestreamError("EmptyImage")
            self.out |= {"width": h["x1"] - h["x0"], "height": h["y1"] - h["y0"], "repairs": s.repairs}
            for t in range(h["tiles_wide"] * h["tiles_high"]) if tiles is None else tiles:
                rect = tile_rect(h, t)
                if rect[2] > rect[0] and rect[3] > rect[1]:
                    self.tiles.append(Tile.open(data, s, t, not permissive, max_coefficients, s.repairs))
        except (CodestreamError, *DAMAGE) as e:
            self.fail(e)

    def fail(self, e: Exception) -> None:
        self.out |= {"error": error(e), "components": None}
        self.tiles = []

    def pieces(self, found: Iterator[np.ndarray]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(component, x, y, finished plane) of every tile, with places in the image's components."""
        for tile in self.tiles:
            rect = tile_rect(self.header, tile.number)
            for c, (spec, plane) in enumerate(zip(self.header["components"], tile.planes([next(found) for _ in tile.jobs]), strict=True)):
                x, y = -(-rect[0] // spec["dx"]) - self.rects[c][0], -(-rect[1] // spec["dy"]) - self.rects[c][1]
                yield c, x, y, finish(plane, spec["depth"], spec["signed"])

    def image(self, found: list[np.ndarray]) -> dict:
        """The whole image; tiles that were not asked for are mid-grey."""
        if not self.out["error"]:
            try:
                specs = self.header["components"]
                planes = [np.full((r[3] - r[1], r[2] - r[0]), 0 if c["signed"] else 1 << (c["depth"] - 1), np.int32) for r, c in zip(self.rects, specs, strict=True)]
                for c, x, y, p in self.pieces(iter(found)):
                    planes[c][y : y + p.shape[0], x : x + p.shape[1]] = p
                self.out["components"] = [{"width": p.shape[1], "height": p.shape[0], **{k: c[k] for k in ("dx", "dy", "depth", "signed")}, "samples": p.ravel()} for p, c in zip(planes, specs, strict=True)]
            except (CodestreamError, *DAMAGE) as e:
                self.fail(e)
        return self.out

    def parts(self, found: list[np.ndarray]) -> dict:
        """The asked tiles' planes alone."""
        if not self.out["error"]:
            try:
                self.out["planes"] = [{"component": c, "x": x, "y": y, "width": p.shape[1], "height": p.shape[0], "samples": p.ravel().astype(np.int32)} for c, x, y, p in self.pieces(iter(found))]
            except (CodestreamError, *DAMAGE) as e:
                self.fail(e)
        return {"planes": None, **self.out}


def decode_files(every: Iterable[tuple[bytes | None, list[int] | None]], permissive: bool = False, max_samples: int = headers.MAX_SAMPLES, max_coefficients: int = headers.MAX_COEFFICIENTS, whole: bool = True) -> Iterator[dict]:
    """Each file's components (or, unless ``whole``, planes of the asked tiles), repairs and error (None if it could be
    decoded), from (bytes, tiles asked for). Files are opened and decoded in groups of bounded size. Never raises on
    bad bytes."""
    files: list[File] = []

    def done() -> Iterator[dict]:
        found = decode_jobs([j for f in files for t in f.tiles for j in t.jobs])
        at = 0
        for f in files:
            n = sum(len(t.jobs) for t in f.tiles)
            yield (f.image if whole else f.parts)(found[at : at + n])
            at += n

    size = 0
    for data, tiles in every:
        files.append(f := File(data or b"", permissive, max_samples, max_coefficients, tiles))
        size += sum(j[0] * j[1] + 256 for t in f.tiles for j in t.jobs) + 1024
        if size > TOGETHER:
            yield from done()
            files, size = [], 0
    yield from done()


def tile_jobs(data: bytes, t: int, permissive: bool, max_samples: int, max_coefficients: int) -> list[dict]:
    """The blocks of a tile's own codestream, for decoding elsewhere; none if it cannot be opened."""
    f = File(data, permissive, max_samples, max_coefficients, [t])
    jobs = [j for tile in f.tiles for j in tile.jobs]
    return [{"n": i, **dict(zip(("width", "height", "band", "planes", "style"), j, strict=False)), "segments": [{"passes": n, "data": b} for n, b in j[5]]} for i, j in enumerate(jobs)]


def finish_tile(data: bytes, tiles: list[int], values: list[bytes] | None, permissive: bool, max_samples: int, max_coefficients: int) -> dict:
    """A tile's planes from the coefficients of its blocks, in the order of ``tile_jobs``."""
    f = File(data, permissive, max_samples, max_coefficients, tiles)
    jobs = [j for tile in f.tiles for j in tile.jobs]
    return f.parts([np.frombuffer(v, "<i4").reshape(j[1], j[0]).astype(np.int64) for v, j in zip(values or [], jobs, strict=True)])


def decode_file(data: bytes, permissive: bool = False, max_samples: int = headers.MAX_SAMPLES, max_coefficients: int = headers.MAX_COEFFICIENTS, tiles: list[int] | None = None) -> dict:
    return next(decode_files([(data, tiles)], permissive, max_samples, max_coefficients))


def export_raster(components: list[dict], width: int, height: int, raw: bool = False) -> bytes:
    """PGM (one or two components) or PPM (the first three) of 8 bits, or the interleaved bytes of all components."""
    planes = []
    for c in components:
        top = (1 << c["depth"]) - 1
        v = np.array(c["samples"], np.int64).reshape(c["height"], c["width"]) + ((1 << (c["depth"] - 1)) if c["signed"] else 0)
        v = np.clip(v, 0, top) * 255 // top
        planes.append(v[np.minimum(np.arange(height) // c["dy"], c["height"] - 1)][:, np.minimum(np.arange(width) // c["dx"], c["width"] - 1)])
    planes = planes if raw else planes[:3] if len(planes) >= 3 else planes[:1]
    body = np.stack(planes, -1).astype(np.uint8).tobytes()
    return body if raw else f"P{6 if len(planes) == 3 else 5}\n{width} {height}\n255\n".encode() + body
