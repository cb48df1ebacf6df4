"""Kernels, headers, decoding, errors and repairs of the codestream operators."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.kernels import arithmetic, blocks, lanes, packets, wavelet
from codelake.operators import decode as op
from codelake.operators import encode, image, report
from codelake.sources import headers


def lcg(n):
    s, out = 7, []
    for _ in range(n):
        s = (s * 1103515245 + 12345) & 0xFFFFFFFF
        out.append(s >> 16)
    return out


def test_bit_reader():
    b = packets.Bits(bytes([0xFF, 0x00, 0xFF]), 0)
    assert [b.take(8), b.take(7), b.take(8)] == [255, 0, 255]
    b = packets.Bits(b"\x80", 0)
    assert b.take(12) == 0x800 and b.over


def test_raw_reader():
    r = arithmetic.Raw(bytes([0xFF, 0x7F]))
    assert [r.bit() for _ in range(15)] == [1] * 15


class Script:
    def __init__(self, bits):
        self.bits = list(bits)

    def bit(self):
        return self.bits.pop(0)


def test_tag_tree_resumes():
    from codelake.operators.encode import _Bits, _Told

    leaves = {(x, y): v for (x, y), v in zip([(x, y) for y in range(2) for x in range(3)], (1, 3, 2, 2, 2, 1), strict=True)}
    bits = _Bits()
    told = _Told(bits, 3, 2, leaves)
    ask = [(x, y, limit) for limit in (1, 3, 9) for (x, y) in leaves]
    for x, y, limit in ask:
        told.tell(x, y, limit)
    source, tree = packets.Bits(bits.end() + bytes(4), 0), packets.Tree(3, 2)
    for x, y, limit in ask:
        assert tree.read(x, y, limit, source) == (leaves[x, y] if leaves[x, y] < limit else None)


def test_arithmetic_round_trip_and_damage():
    bits = [v & 1 if v % 5 else 0 for v in lcg(4096)]
    out = arithmetic.Encoder(arithmetic.fresh())
    for i, b in enumerate(bits):
        out.bit(i % 19, b)
    data = out.end()
    read = lambda d: [x.bit(i % 19) for x in [arithmetic.Decoder(d, arithmetic.fresh())] for i in range(4096)]
    assert read(data) == bits
    assert read(data[:50] + bytes([data[50] ^ 1]) + data[51:]) != bits
    assert len(read(b"")) == 4096


@pytest.mark.parametrize("band", ["LL", "HL", "LH", "HH"])
def test_blocks(band):
    r = np.random.default_rng(4)
    for shape in ((1, 1), (3, 5), (8, 8), (13, 4)):
        v = r.laplace(0, 20, shape).astype(np.int64)
        planes, n, data = blocks.encode(v, band)
        assert (blocks.decode(shape[1], shape[0], band, planes, 0, [(n, data)]) == v).all()
        if n > 4:
            part = blocks.decode(shape[1], shape[0], band, planes, 0, [(n - 3, data)])
            assert np.abs(part - v).max() <= 1  # the last plane is missing: the middle of the interval


@pytest.mark.parametrize("style", [0, blocks.BYPASS, blocks.RESET, blocks.TERMINATE, blocks.CAUSAL, blocks.MARKS, 5, 14, 47])
def test_lanes(style):
    """Lanes write what the scalar writer writes, and read like the scalar reader, damaged segments too."""
    r = np.random.default_rng(4)
    values = [((r.laplace(0, k, shape)).astype(np.int64) * (k > 1 or band != "HH"), band) for shape in ((1, 1), (3, 5), (8, 8), (13, 4)) for band in ("LL", "HL", "LH", "HH") for k in (1, 20, 300)]
    written = lanes.encode_blocks(values, style)
    jobs = [(v.shape[1], v.shape[0], band, p, style, s) for (v, band), (p, s) in zip(values, written, strict=True)]
    if not style:
        assert [(p, sum(n for n, _ in s), b"".join(b for _, b in s)) for p, s in written] == [blocks.encode(v, band) for v, band in values]
    for j, x, (v, _) in zip(jobs, lanes.decode_blocks(jobs), values, strict=True):
        assert (x == v).all() and (blocks.decode(*j) == v).all()
    bad = [(*j[:5], [(n, bytes(b ^ (int(r.integers(256)) if r.random() < 0.2 else 0) for b in d[: r.integers(0, len(d) + 1)])) for n, d in j[5]]) for j in jobs]
    for j, x in zip(bad, lanes.decode_blocks(bad), strict=True):
        assert (blocks.decode(*j) == x).all()


def test_termination_rules():
    assert [i for i in range(16) if blocks.ends_segment(i, blocks.BYPASS)] == [9, 11, 12, 14, 15]
    assert all(blocks.ends_segment(i, blocks.TERMINATE) for i in range(9))
    assert [i for i in range(16) if blocks.is_raw(i, blocks.BYPASS)] == [10, 11, 13, 14]


def test_wavelets():
    for n in range(1, 40):
        for start in (0, 1, 6, 7):
            v = (37 * np.arange(n)) % 211 - 105
            assert (wavelet.synthesise_53(wavelet.analyse_53(v, start), start) == v).all()
    for n in (2, 3, 8, 9, 16, 31):
        for start in (0, 1):
            assert np.abs(wavelet.synthesise_97(np.where((np.arange(n) + start) % 2 == 0, 100, 0), start) - 100).max() < 0.01


def test_exact_integer_rules():
    assert image.round_away(np.array([2.5, -2.5, 0.4, -0.5], np.float32)).tolist() == [3, -3, 0, -1]
    r, g, b = image.inverse_rct(np.array([0]), np.array([-5]), np.array([0]))
    assert (g[0], r[0], b[0]) == (2, 2, -3)
    assert image.finish(np.array([[300, -300]]), 8, False).tolist() == [[255, 0]] and image.finish(np.array([[300, -300]]), 8, True).tolist() == [[127, -128]]


OPTIONS = [{}, {"tile": 8}, {"tile": 9, "progression": 3}, {"precincts": 3, "progression": 2, "levels": 3}, {"progression": 4, "eph": True}, {"progression": 1, "levels": 0}, {"mct": True}, {"mct": True, "precincts": 4, "tile": 11, "progression": 4}, {"levels": 6}]


@pytest.mark.parametrize("options", OPTIONS)
def test_round_trips(options):
    r = np.random.default_rng(1)
    for shape in ((14, 20), (1, 1), (33, 70)):
        planes = [r.integers(0, 256, shape) for _ in range(3 if options.get("mct") else 1)]
        d = image.decode_file(encode.encode_image(planes, **options))
        assert d["error"] is None and d["repairs"] == [] and [c["samples"].tolist() for c in d["components"]] == [p.ravel().tolist() for p in planes]


def test_signed_and_deep():
    p = np.random.default_rng(2).integers(-2048, 2048, (9, 9))
    d = image.decode_file(encode.encode_image([p], depth=12, signed=True))
    assert d["components"][0]["samples"].tolist() == p.ravel().tolist() and d["components"][0]["depth"] == 12


def test_strict_and_permissive():
    b = encode.encode_image(encode.golden_picture(), mct=True, declared=9)
    assert image.decode_file(b)["error"]["kind"] == "MalformedMarkerSegment"
    d = image.decode_file(b, True)
    assert d["repairs"][0]["kind"] == "TilePartCountDisagrees" and d["repairs"][0]["declared"] == 9
    assert d["components"][0]["samples"].tolist() == encode.golden_picture()[0].ravel().tolist()
    assert image.decode_file(headers.write_part_counts(b))["error"] is None


def change(b, marker, at, value):
    i = b.index(struct.pack(">H", marker)) + at
    return b[:i] + bytes([value]) + b[i + 1 :]


def test_errors():
    b = encode.encode_image(encode.golden_picture(channels=1))
    kind = lambda x, **k: image.decode_file(x, **k)["error"]["kind"]
    assert kind(b"%PDF-1.7") == kind(b"") == "NotACodestream"
    assert kind(change(b, headers.COD, 5, 9)) == "UnknownProgression"
    assert kind(change(b, headers.COD, 13, 5)) == "UnknownTransform"
    assert kind(change(b, headers.QCD, 4, 7)) == "UnknownQuantisation"
    assert kind(change(b, headers.SOT, 5, 9)) == "TileIndexOutOfRange"
    assert kind(change(b, headers.SIZ, 40, 31)) == "TooLarge"
    assert kind(change(b, headers.COD, 9, 33)) == "TooLarge"
    assert kind(b, max_samples=100) == "TooLarge" and kind(b, max_coefficients=10) == "TooLarge"
    assert kind(change(b, headers.COD, 1, 0x30)) == "UnknownMarker"
    assert kind(change(b, headers.COD, 1, 0x5F)) == "UnsupportedMarker"  # progression changes are refused, not ignored
    assert kind(b[:-2]) == "UnexpectedEndOfCodestream"
    cut = image.decode_file(b[:-2], True)
    assert [r["kind"] for r in cut["repairs"]] == ["EndOfCodestreamMissing"]
    skipped = image.decode_file(change(b, headers.COD, 1, 0x30), True)
    assert skipped["repairs"][0]["kind"] == "UnknownMarkerSkipped" and skipped["repairs"][0]["marker"] == 0xFF30
    qcd = b.index(struct.pack(">H", headers.QCD))
    size = int.from_bytes(b[qcd + 2 : qcd + 4], "big") + 2
    assert kind(b[:qcd] + b[qcd + size :]) == "MissingCodingStyle"


def test_last_part_may_leave_its_length_open():
    b = encode.encode_image(encode.golden_picture(channels=1))
    i = b.index(struct.pack(">H", headers.SOT))
    d = image.decode_file(b[: i + 6] + bytes(4) + b[i + 10 :])
    assert d["error"] is None and d["components"][0]["samples"].tolist() == encode.golden_picture(channels=1)[0].ravel().tolist()


def test_missing_tile():
    b = encode.encode_image(encode.golden_picture(channels=1), tile=10)
    i = b.rindex(struct.pack(">H", headers.SOT))
    assert image.decode_file(b[:i] + b[-2:])["error"]["kind"] == "UnexpectedEndOfCodestream"
    assert image.decode_file(b[:i] + b[-2:], True)["repairs"][0]["kind"] == "TileMissing"


def test_damage_never_raises():
    b = encode.encode_image(encode.golden_picture(), mct=True, levels=3, tile=13)
    for n in (1, 2, 8, 40, 60, 100, 200, 400, 800, len(b) - 1):
        image.decode_file(b[:n], True, max_samples=100_000)
    for i in range(0, len(b), 7):
        for m in (0xFF, 0x01, 0x80):
            image.decode_file(b[:i] + bytes([b[i] ^ m]) + b[i + 1 :], True, max_samples=100_000)


def test_width_beyond_32_bits(spark):
    """One sample, 2**32 - 1 reference columns wide, on one row: nothing fails the job."""
    b = encode.encode_image([np.array([[7]])])
    i = b.index(struct.pack(">H", headers.SIZ))
    size = struct.pack(">IIIIIIII", 2**32 - 1, 1, 0, 0, 2**32 - 1, 1, 0, 0)
    b = b[: i + 6] + size + b[i + 38 : i + 41] + bytes([255, 1]) + b[i + 43 :]
    d = spark.createDataFrame([(1, b), (2, encode.encode_image([np.array([[7]])]))], "k int, content binary")
    got = {r.k: r for r in op.decode(d, ["k"], max_samples=1 << 25).collect()}
    assert (got[1].width, got[1].height) == (2**32 - 1, 1) and got[2].components[0].samples == [7]
    assert {r.k for r in op.decode_by_tile(d, ["k"], max_samples=1000).where("error is null").collect()} == {2}
    assert op.headers(d, ["k"]).where("k = 1").first().header.x1 == 2**32 - 1


def test_by_block_is_by_tile(spark):
    """Blocks as rows of their own give the same tiles, with repeated rows, null keys, damage and errors."""
    rgb = encode.golden_picture(33, 70)
    whole = encode.encode_image(rgb, mct=True, tile=32, layers=2, block=(3, 3))
    d = spark.createDataFrame([("a", whole), ("a", whole), (None, encode.encode_image(rgb[:1], lossy=1 / 8)), ("cut", whole[:-200]), ("bad", b"nothing"), ("null", None)], "k string, content binary")
    for mode in ("strict", "permissive"):
        one, two = (op.decode_by_tile(d, ["k"], mode, by_block=b).collect() for b in (False, True))
        assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) > 10


def test_by_tile_keeps_files_with_errors(spark):
    whole = encode.encode_image(encode.golden_picture(channels=1), tile=8)
    d = spark.createDataFrame([("good", whole), ("bad", b"nothing"), ("null", None), ("cut", whole[:-40])], "k string, content binary")
    got = op.decode_by_tile(d, ["k"]).select("k", "tile", "error.kind", F.size("planes").alias("n")).collect()
    assert sorted((r.k, r.kind) for r in got if r.tile is None) == [("bad", "NotACodestream"), ("cut", "TruncatedMarkerSegment"), ("null", "NotACodestream")]
    assert sorted((r.tile, r.n) for r in got if r.k == "good") == [(t, 1) for t in range(6)]
    mended = op.decode_by_tile(d.where("k = 'cut'"), ["k"], "permissive").collect()
    assert len(mended) == 6 and {x.kind for r in mended for x in r.repairs} >= {"PacketsRunPastTheirTile"}


def test_override_precedence():
    s = headers.Style(cod=headers.Blocks(levels=1), coc={1: headers.Blocks(levels=2)})
    t = headers.Style(base=s, cod=headers.Blocks(levels=3))
    assert (s.blocks(0).levels, s.blocks(1).levels, t.blocks(1).levels) == (1, 2, 3)
    t.coc[1] = headers.Blocks(levels=4)
    assert t.blocks(1).levels == 4


def test_position_orders_clamp_to_the_tile():
    style = headers.Style(cod=headers.Blocks(1, 6, 6, 0, True, [(6, 6), (5, 5)]), qcd=headers.Steps(0, 2, [(8, 0)] * 4))
    tree = [packets.build_component((0, 64, 64, 96), style, c, 1, 1, True, 1 << 20) for c in range(2)]
    order = packets.packet_order(tree, [(1, 1)] * 2, 3, 1, (0, 64))
    assert [(c, r) for _, r, c, _ in order] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 1), (1, 1)]


def test_container_fields():
    pal = struct.pack(">HB", 2, 2) + bytes([7, 0x87]) + bytes([1, 0xFF, 2, 0x80])
    inner = encode.box(b"colr", bytes([1, 0, 0]) + struct.pack(">I", 99)) + encode.box(b"pclr", pal) + encode.box(b"cmap", struct.pack(">HBB", 0, 1, 1)) + encode.box(b"cdef", struct.pack(">HHHH", 1, 0, 1, 2))
    c = headers.container(encode.box(b"jP  ", b"x") + encode.box(b"jp2h", inner) + struct.pack(">I4sQ", 1, b"jp2c", 20) + b"\xff\x4f\0\0")
    assert c["colour_space"] == {"name": "Other", "code": 99} and c["palette"] == [[1, -1], [2, -128]] and c["component_map"] == [{"cmp": 0, "mtyp": 1, "pcol": 1}]
    assert c["channel_definitions"] == [{"cn": 0, "typ": 1, "asoc": 2}] and c["end"] - c["start"] == 4


def test_embedded_streams():
    b = encode.header_only(8, 8)
    doc = b"%PDF\n1 0 obj << /Subtype /Image /Filter /JPXDecode /Length " + str(len(b)).encode() + b" >>\nstream\n" + b + b"\nendstream\n2 0 obj << /Length 3 >>\nstream\nabc\nendstream"
    assert headers.pdf_image_streams(doc) == [b]


def test_export():
    c = [{"width": 2, "height": 1, "dx": 1, "dy": 1, "depth": 4, "signed": False, "samples": [0, 15]}] * 3
    assert image.export_raster(c, 2, 1) == b"P6\n2 1\n255\n\0\0\0\xff\xff\xff" and image.export_raster(c[:1], 2, 1, raw=True) == b"\0\xff"


def test_dataframes(spark, tmp_path):
    good, bad = encode.wrap(encode.encode_image(encode.golden_picture(), mct=True)), encode.encode_image(encode.golden_picture(channels=1), tile=8)
    for n, b in (("a.jp2", good), ("b.j2k", bad), ("c.bin", b"nothing")):
        (tmp_path / n).write_bytes(b)
    files = op.read_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    got = {r.path: r for r in op.decode(files, ["path"]).collect()}
    assert got["a.jp2"].colour_space.name == "Grey" and len(got["a.jp2"].components) == 3 and got["c.bin"].error.kind == "NotACodestream"
    h = {r.path: r for r in op.headers(files, ["path"]).collect()}
    assert len(h["b.j2k"].tile_parts) == 6 and h["b.j2k"].tile_style.levels == 2 and h["c.bin"].header is None
    assert [r.kind for r in op.boxes(files, ["path"]).where("path = 'a.jp2'").orderBy("ord").collect()] == ["jP  ", "ftyp", "jp2h", "ihdr", "colr", "jp2c"]
    tiles = op.decode_by_tile(files, ["path"]).where("path = 'b.j2k'").collect()
    plane = np.zeros((14, 20), int)
    for t in tiles:
        for p in t.planes:
            plane[p.y : p.y + p.height, p.x : p.x + p.width] = np.array(p.samples).reshape(p.height, p.width)
    assert plane.tolist() == encode.golden_picture()[0].tolist()
    null = spark.createDataFrame([("x", None)], "path string, content binary")
    assert op.decode(null, ["path"]).first().error.kind == "NotACodestream" and op.decode(null.limit(0), ["path"]).count() == 0


def test_stream(spark, tmp_path):
    from codelake.streaming.files import decode_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(encode.encode_image(encode.golden_picture(channels=1)))
    q = decode_stream(spark, str(tmp_path / "in")).select("width", "height").writeStream.format("memory").queryName("decoded").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("decoded").collect()] == [(20, 14)]


def test_verdicts(spark):
    rows = [("a", 1, 1), ("b", 1, 3), ("c", 1, 9), ("d", None, 1), ("e", 1, None), ("f", 1, 1), ("f", None, 2)]
    got = {r.k: r.verdict for r in report.verdicts(spark.createDataFrame(rows, "k string, ours int, theirs int"), ["k"], 3).collect()}
    assert got == {"a": "exact", "b": "within-tolerance", "c": "differs", "d": "refused", "e": "no-reference", "f": "shape"}
