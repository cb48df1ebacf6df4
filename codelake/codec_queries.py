"""Queries of the codec's options, containers, errors and reports, each with the SQL of what it must give.

Pictures come from table values and are written by ``operators.encode``; what a decoder must give back is then known
in SQL. Steps of the irreversible filter are fine enough there that rounding restores every sample.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.operators import decode as op
from codelake.operators import encode, report
from codelake.plans import geometry
from codelake.registry import _BANDS, _RASTER, _raster_files, _raster_sql, _resolutions, query, spread, table
from codelake.session import ship
from codelake.sources import headers


def _bytes_by_position(files: DataFrame, head: int) -> DataFrame:
    """(img, pos, value) of a file's bytes after its header of ``head`` bytes."""
    each = F.transform(F.sequence(F.lit(head + 1), F.length("file")), lambda i: F.conv(F.hex(F.call_function("substring", F.col("file"), i, F.lit(1))), 16, 10).cast("int"))
    return files.select("img", F.posexplode(each).alias("pos", "value"))


# --- whole images through the options of the codec


@query(_raster_sql("r"))
def decode_lossy(spark, sf):
    """9/7 filter, expounded steps."""
    return op.samples(op.decode(_raster_files(spark, sf, "r", lossy=1 / 16, levels=3), ["img"]), ["img"])


@query(_raster_sql("rgb"))
def decode_lossy_rgb(spark, sf):
    """9/7 filter, derived steps, irreversible colour transform."""
    return op.samples(op.decode(_raster_files(spark, sf, "rgb", lossy=1 / 64, quantisation=1, mct=True, levels=2), ["img"]), ["img"])


@query(_raster_sql("g"))
def decode_layers(spark, sf):
    """Four layers, tile-parts in turns over the tiles, packet marks, small blocks."""
    return op.samples(op.decode(_raster_files(spark, sf, "g", layers=4, parts=3, tile=9, precincts=3, progression=2, sop=True, eph=True, block=(2, 3)), ["img"]), ["img"])


STYLES = (0, 1, 2, 4, 8, 32, 5, 47)  # bypass 1, reset 2, terminate 4, causal 8, marks 32


@query(_raster_sql("b"))
def decode_styles(spark, sf):
    """All block styles, one a picture, in two layers."""
    return op.samples(op.decode(_raster_files(spark, sf, "b", by_img=lambda i: {"style": STYLES[i % len(STYLES)]}, layers=2, depth=12, levels=1), ["img"]), ["img"])


@query(_raster_sql("rgb"))
def decode_overrides(spark, sf):
    """Levels by component and by tile, a region of interest."""
    return op.samples(op.decode(_raster_files(spark, sf, "rgb", levels=2, tile=9, component_levels={1: 4, 2: 0}, tile_levels={1: 3}, roi={0: 12}), ["img"]), ["img"])


_SUBSAMPLED = {"r": (1, 1), "g": (2, 1), "b": (2, 2)}


def _sub_sql(select: str) -> str:
    o = f"with o as (select o_orderkey // 256 as img, o_orderkey % 256 as p, {', '.join(f'{_RASTER[c]} as {c}' for c in 'rgb')} from orders), g as (select i.img, x.p, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b from (select distinct img from o) i cross join (select unnest(range(256)) as p) x left join o on o.img = i.img and o.p = x.p)"
    return f"{o} {select}"


@query(_sub_sql("""select img, cast(0 as int) as component, cast(p as int) as pos, cast(r as int) as value from g
union all select img, 1, cast(p // 2 as int), cast(g as int) from g where p % 2 = 0 union all select img, 2, cast(p // 32 * 8 + p % 16 // 2 as int), cast(b as int) from g where p % 2 = 0 and p // 16 % 2 = 0"""))
def decode_subsampled(spark, sf):
    return op.samples(op.decode(_raster_files(spark, sf, "rgb", sampling=list(_SUBSAMPLED.values()), levels=2, progression=3), ["img"]), ["img"])


@query(_sub_sql("""select g.img, cast(g.p * 3 + c as int) as pos, cast(case c when 0 then g.r when 1 then x.g else y.b end as int) as value
from g join g x on x.img = g.img and x.p = g.p - g.p % 2 join g y on y.img = g.img and y.p = g.p // 32 * 32 + g.p % 16 - g.p % 2, (select unnest([0, 1, 2]) as c)"""))
def export_rgb(spark, sf):
    """P6 bytes by position; subsampled components repeat their samples."""
    files = op.export(op.decode(_raster_files(spark, sf, "rgb", sampling=list(_SUBSAMPLED.values()), levels=2), ["img"]), ["img"])
    return _bytes_by_position(files.where("substring(file, 1, 13) = cast('P6\\n16 16\\n255\\n' as binary)"), 13)


@query(_sub_sql("select img, cast(p * 2 + c as int) as pos, cast(case c when 0 then r * 255 // 4095 else g * 255 // 4095 end as int) as value from g, (select unnest([0, 1]) as c)"))
def export_raw(spark, sf):
    """Interleaved bytes of two components of twelve bits."""
    return _bytes_by_position(op.export(op.decode(_raster_files(spark, sf, "rg", depth=12), ["img"]), ["img"], raw=True), 0)


# --- one picture under every option, as a table of verdicts


def _options() -> list[tuple[str, int, str, dict]]:
    """(name, channels, verdict, options): 22 options one at a time, then each progression plain and tiled."""
    fine, coarse = {"lossy": 1 / 16}, {"lossy": 0.4}
    small = {"tile": 64}
    listed = [
        ("baseline-lossless", 3, "exact", {"mct": True, "levels": 5}), ("baseline-lossy", 3, "within-tolerance", {"mct": True, "levels": 5, **coarse}), ("greyscale", 1, "exact", {"levels": 5}), ("alpha", 4, "exact", {"mct": True}), ("no-colour-transform", 3, "exact", {}),
        ("one-resolution", 3, "exact", {"levels": 0}), ("two-resolutions", 3, "exact", {"levels": 1}), ("seven-resolutions", 3, "exact", {"levels": 6}), ("small-code-blocks", 3, "exact", {"block": (4, 4)}), ("wide-code-blocks", 3, "exact", {"block": (6, 4)}), ("large-code-blocks", 3, "exact", {"block": (6, 6)}),
        ("precincts", 3, "exact", {"precincts": 7}), ("small-precincts", 3, "exact", {"precincts": 6}), ("tiles", 3, "exact", small), ("tiles-offset", 3, "exact", {**small, "origin": (7, 5)}), ("tiles-and-precincts", 3, "exact", {**small, "precincts": 5}),
        ("many-layers", 3, "exact", {"layers": 6}), ("lossy-layers", 3, "within-tolerance", {"layers": 6, **coarse}), ("lossy-tiles", 3, "exact", {**small, **fine}), ("lossy-precincts", 3, "exact", {"precincts": 6, **fine}), ("lossy-greyscale", 1, "exact", fine), ("jp2-wrapper", 3, "exact", {"wrapped": True}),
    ]
    for i, name in enumerate(headers.PROGRESSIONS):
        listed += [(f"progression-{name.lower()}", 3, "exact", {"progression": i}), (f"progression-{name.lower()}-tiled", 3, "exact", {"progression": i, **small, "precincts": 5})]
    return listed


def _sweep_picture(channels: int) -> list[np.ndarray]:
    y, x = np.mgrid[:80, :100]
    return [(x * (5 + c) + y * (3 * c + 1) + (x * y + 7 * c) % 61) % 256 for c in range(channels)]


@query(f"select * from (values {', '.join(f'''('{n}', 0, cast({8000 * c} as bigint), '{v}')''' if v == 'exact' else f'''('{n}', 1, cast({8000 * c} as bigint), '{v}')''' for n, c, v, _ in _options())}) t(name, differs, total, verdict)")
def option_sweep(spark, sf):
    """Every option, written, decoded and compared with tolerance 3. ``differs``: whether any sample does."""
    ship(spark)

    def made(parts):
        for p in parts:
            out = []
            for i in p["i"]:
                name, channels, _, options = _options()[i]
                options = dict(options)
                wrapped = options.pop("wrapped", False)
                b = encode.encode_image(_sweep_picture(channels), **options)
                out.append((name, encode.wrap(b) if wrapped else b))
            yield pd.DataFrame(out, columns=["name", "content"])

    n = len(_options())
    files = spark.range(n).selectExpr("cast(id as int) as i").repartition(n, "i").mapInPandas(made, "name string, content binary")
    ours = op.samples(op.decode(files, ["name"]), ["name"])
    value = "cast(((x * (5 + component) + y * (3 * component + 1) + (x * y + 7 * component) % 61) % 256) as int)"
    pairs = ours.selectExpr("name", "component", "value as ours", "pos % 100 as x", "pos div 100 as y").selectExpr("name", "ours", f"{value} as theirs")
    return report.verdicts(pairs, ["name"], tolerance=3).select("name", F.when(F.col("worst") > 0, 1).otherwise(0).alias("differs"), "total", "verdict")


# --- containers and documents


@query("""select p_partkey as img, case p_partkey % 4 when 0 then 'RGB' when 1 then 'Grey' when 2 then 'YCC' else 'Other' end as colour, cast(p_partkey % 4 + 16 as bigint) as code, cast(1 + p_size % 3 as int) as n_definitions,
cast((p_size % 3) * 7 as int) as last_asoc, cast(1 + p_size % 5 as int) as n_entries, cast(case when p_size % 5 < 100 then p_size % 5 - 2 end as int) as last_signed, cast(2 as int) as n_maps, cast(p_size % 250 as int) as column_of_palette from part""")
def container_fields(spark, sf):
    """Colour space, channel definitions, palette and component map of wrapped files."""
    ship(spark)

    @F.pandas_udf("binary")
    def made(key: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for k, s in zip(key.astype(int), size.astype(int), strict=True):
            colour = encode.box(b"colr", bytes([1, 0, 0]) + struct.pack(">I", 16 + k % 4))
            known = encode.box(b"cdef", struct.pack(">H", 1 + s % 3) + b"".join(struct.pack(">HHH", i, 0, 7 * i) for i in range(1 + s % 3)))
            palette = encode.box(b"pclr", struct.pack(">HB", 1 + s % 5, 2) + bytes([7, 0x87]) + b"".join(struct.pack(">Bb", i, i - 2) for i in range(1 + s % 5)))
            maps = encode.box(b"cmap", struct.pack(">HBBHBB", 0, 1, 0, 0, 1, s % 250))
            out.append(encode.box(b"jP  ", b"\r\n\x87\n") + encode.box(b"jp2h", colour + known + palette + maps) + encode.box(b"jp2c", encode.header_only(8, 8)))
        return pd.Series(out)

    files = spread(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("img"), made("p_partkey", "p_size").alias("content"))
    last = lambda c: F.element_at(c, -1)
    return op.headers(files, ["img"]).select(
        "img", F.col("colour_space.name").alias("colour"), F.col("colour_space.code").alias("code"), F.size("channel_definitions").alias("n_definitions"), last("channel_definitions")["asoc"].alias("last_asoc"),
        F.size("palette").alias("n_entries"), last(last("palette")).alias("last_signed"), F.size("component_map").alias("n_maps"), last("component_map")["pcol"].alias("column_of_palette"),
    )


@query("""select p_partkey as img, cast(i as int) as ord, cast(2 + 43 + 14 + 5 + 3 * (p_size % 4) + 1 + 14 + 2 as bigint) as n_bytes, true as whole from part, (select unnest(range(3)) as i) where i < p_size % 4""")
def pdf_streams(spark, sf):
    """Image streams of documents: nested dictionaries, with a length, with an indirect one, and with none."""
    ship(spark)

    @F.pandas_udf("binary")
    def made(size: pd.Series) -> pd.Series:
        out = []
        for s in size.astype(int):
            b = encode.header_only(8, 8, levels=s % 4)
            lengths = (b"/Length %d" % len(b), b"/Length 9 0 R", b"")
            objects = [b"%d 0 obj << /DecodeParms << /A << /B << /C [ 1 2 ] >> >> >> /Subtype /Image /Filter [ /JPXDecode ] /Mask << /D << /E 1 >> >> %s >>\nstream\r\n%s\nendstream endobj\n" % (i + 1, lengths[i], b) for i in range(min(s % 4, 3))]
            out.append(b"%PDF-1.7\n" + b"8 0 obj << /Filter /FlateDecode /Length 3 >>\nstream\nabc\nendstream endobj\n" + b"".join(objects) + b"9 0 obj << /Names [ /JPXDecode ] >> endobj\n%%EOF")
        return pd.Series(out)

    docs = spread(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("img"), made("p_size").alias("content"))
    found = op.document_images(docs, ["img"])
    found = found.withColumn("n_bytes", F.length("content").cast("long"))
    return op.headers(found, ["img", "ord", "n_bytes"], columns=["error"]).select("img", "ord", "n_bytes", F.col("error").isNull().alias("whole"))


@query("select p_partkey as img, case p_partkey % 3 when 0 then 'FF4FFF51' when 1 then 'FF4FFF51' else '6E6F7468' end as begins, cast(case p_partkey % 3 when 2 then 7 else 2 + 43 + 14 + 6 + 3 * (p_size % 4) + 14 + 2 end as int) as n_bytes from part")
def unwrapped(spark, sf):
    """Codestreams of containers and of bare files; anything else as it is."""
    ship(spark)

    @F.pandas_udf("binary")
    def made(key: pd.Series, size: pd.Series) -> pd.Series:
        each = (lambda b: encode.wrap(b), lambda b: b, lambda b: b"nothing")
        return pd.Series([each[k % 3](encode.header_only(8, 8, levels=s % 4)) for k, s in zip(key.astype(int), size.astype(int), strict=True)])

    files = spread(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("img"), made("p_partkey", "p_size").alias("content"))
    return op.unwrap(files, ["img"]).select("img", F.hex(F.substring("content", 1, 4)).alias("begins"), F.length("content").alias("n_bytes"))


# --- styles, parts, limits


def _styled_files(spark, sf):
    ship(spark)

    @F.pandas_udf("binary")
    def made(key: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([encode.header_only(16, 8, 3, levels=s % 5, parts=(1 + s % 2, 1 + k % 3), turns=True, component_levels={1: k % 6} if k % 2 else {}, tile_levels={1: 1 + s % 3} if k % 3 else {}) for k, s in zip(key.astype(int), size.astype(int), strict=True)])

    return spread(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("img"), made("p_partkey", "p_size").alias("content"))


@query("""with c as (select unnest([0, 1, 2]) as component), m as (select p_partkey as img, cast(null as int) as tile, component, case when component = 1 and p_partkey % 2 = 1 then p_partkey % 6 else p_size % 5 end as levels from part, c),
t as (select p_partkey as img, 1 as tile, component, 1 + p_size % 3 as levels from part, c where p_partkey % 3 <> 0) select img, tile, cast(component as int) as component, cast(levels as int) as levels, '5/3' as transform, 'none' as quant_style from (select * from m union all select * from t)""")
def style_override(spark, sf):
    """Levels of every component by default and in tiles with headers of their own: the tile's, else the component's."""
    found = op.headers(_styled_files(spark, sf), ["img"], "strict")
    return found.select("img", F.explode("component_styles").alias("s")).select("img", "s.tile", "s.component", "s.levels", "s.transform", "s.quant_style")


@query("""with p as (select p_partkey as img, t as tile, i as part_index from part, (select unnest([0, 1]) as t), (select unnest([0, 1, 2]) as i) where i < case t when 0 then 1 + p_size % 2 else 1 + p_partkey % 3 end)
select img, cast(tile as int) as tile, cast(part_index as int) as part_index, cast(row_number() over (partition by img order by part_index desc, tile) - 1 as int) as seq, cast(row_number() over (partition by img order by tile, part_index) - 1 as int) as pos from p""")
def tile_part_order(spark, sf):
    """Tile-parts by tile and index, whatever their order in the file."""
    found = op.headers(_styled_files(spark, sf), ["img"], "strict")
    return found.select("img", F.posexplode("tile_parts").alias("pos", "p")).select("img", "p.tile", "p.part_index", "p.seq", "pos")


@query("""select p_partkey as img, cast(i as int) as part_index, cast(2 + 43 + 14 + 6 + 3 * (p_size % 5) + 14 * i as bigint) as sot, cast(2 + 43 + 14 + 6 + 3 * (p_size % 5) + 14 * (i + 1) as bigint) as "end" from part, (select unnest(range(3)) as i) where i <= p_size % 3""")
def tile_part_offsets(spark, sf):
    ship(spark)

    @F.pandas_udf("binary")
    def made(size: pd.Series) -> pd.Series:
        return pd.Series([encode.header_only(8, 8, levels=s % 5, parts=(1 + s % 3,)) for s in size.astype(int)])

    files = spread(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("img"), made("p_size").alias("content"))
    return op.headers(files, ["img"], "strict").select("img", F.explode("tile_parts").alias("p")).select("img", "p.part_index", "p.sot", "p.end")


@query("""select p_partkey as img, mode, case when (8 + 8 * (p_size % 3)) * 8 * (1 + 2 * (p_partkey % 2)) > 300 then 'TooLarge' when (8 + 8 * (p_size % 3)) >= 8 * 3 then cast(null as varchar) end as error,
cast(case when (8 + 8 * (p_size % 3)) * 8 * (1 + 2 * (p_partkey % 2)) > 300 then -1 else 1 + 2 * (p_partkey % 2) end as int) as n_components from part, (select unnest(['strict', 'permissive']) as mode)""")
def decode_limits(spark, sf):
    """Both modes refuse images beyond a ceiling of samples before anything is allocated."""
    ship(spark)

    @F.pandas_udf("binary")
    def made(key: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([encode.header_only(8 + 8 * (s % 3), 8, 1 + 2 * (k % 2), s % 4, layers=1) for k, s in zip(key.astype(int), size.astype(int), strict=True)])

    files = spread(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("img"), made("p_partkey", "p_size").alias("content"))
    one = lambda mode: op.decode(files, ["img"], mode, max_samples=300).select("img", F.lit(mode).alias("mode"), F.col("error.kind").alias("error"), F.coalesce(F.size("components"), F.lit(-1)).alias("n_components"))
    return report.unioned([one("strict"), one("permissive")])


@query("""select p_partkey as img, tile, case when (8 + tile) * 8 > 70 then 'TooLarge' end as error from part, (select unnest([0, 1]) as tile) where false
union all select p_partkey, cast(t as bigint), case when p_size % 3 = 0 then 'TooLarge' end from part, (select unnest(range(2)) as t)""")
def tile_limits(spark, sf):
    """The ceiling of a tile component: 64 coefficients, or 63."""
    ship(spark)

    @F.pandas_udf("binary")
    def made(size: pd.Series) -> pd.Series:
        return pd.Series([encode.header_only(16, 8, 1, s % 4, layers=1) for s in size.astype(int)])

    files = spread(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("img"), F.col("p_size"), made("p_size").alias("content"))
    some = [op.decode_by_tile(files.where(f"(p_size % 3 = 0) = {low}"), ["img"], max_coefficients=n).select("img", "tile", F.col("error.kind").alias("error")) for low, n in (("true", 63), ("false", 64))]
    return report.unioned(some)


@query(f"""with {_BANDS}, cut as (select *, case when res = 0 then ppx else ppx - 1 end as px, case when res = 0 then ppy else ppy - 1 end as py from bd),
q as (select *, greatest((rx0 // (1 << ppx) + p % pwide) * (1 << px), bx0) as qx0, greatest((ry0 // (1 << ppy) + p // pwide) * (1 << py), by0) as qy0, least((rx0 // (1 << ppx) + p % pwide + 1) * (1 << px), bx1) as qx1, least((ry0 // (1 << ppy) + p // pwide + 1) * (1 << py), by1) as qy1, 1 << least(3, px) as cw, 1 << least(2, py) as ch from (select *, unnest(range(pwide * phigh)) as p from cut))
select img, tile, comp, res, band, p as precinct, cast(case when qx1 > qx0 and qy1 > qy0 then ((qx1 + cw - 1) // cw - qx0 // cw) * ((qy1 + ch - 1) // ch - qy0 // ch) else 0 end as bigint) as n_blocks from q""")
def precinct_blocks(spark, sf):
    """Blocks of every precinct, empty precincts too."""
    return geometry.precincts(geometry.bands(_resolutions(spark, sf)), F.lit(3), F.lit(2)).select("img", "tile", "comp", "res", "band", "precinct", "n_blocks")


# --- errors and repairs


def _at(b: bytes, marker: int, at: int, value: bytes) -> bytes:
    i = b.index(struct.pack(">H", marker)) + at
    return b[:i] + value + b[i + len(value) :]


def _error_cases() -> list[tuple[str, bytes, str, int, int | None]]:
    """(case, file, kind, offset, value) of every kind of error in strict mode. A file of one component of eight bits
    and two levels: size at byte 2, coding at 45, steps at 59, the tile-part at 71."""
    b = encode.encode_image(encode.golden_picture(channels=1))
    qcc = b[:71] + struct.pack(">HHBBBBB", headers.QCC, 7, 5, 64, 64, 72, 72) + b[71:]
    return [
        ("not a codestream", b"%PDF-1.7", "NotACodestream", 0, None),
        ("segment past the end", b[:50], "TruncatedMarkerSegment", 45, None),
        ("zero layers", _at(b, headers.COD, 6, b"\0\0"), "MalformedMarkerSegment", 45, None),
        ("unknown marker", _at(b, headers.COD, 1, b"\x30"), "UnknownMarker", 45, 0xFF30),
        ("progression changes", _at(b, headers.COD, 1, b"\x5f"), "UnsupportedMarker", 45, 0xFF5F),
        ("no tile width", _at(b, headers.SIZ, 22, bytes(4)), "MalformedImageHeader", 6, None),
        ("tile 9", _at(b, headers.SOT, 4, b"\0\x09"), "TileIndexOutOfRange", 71, 9),
        ("component 5", qcc, "ComponentIndexOutOfRange", 71, 5),
        ("progression 9", _at(b, headers.COD, 5, b"\x09"), "UnknownProgression", 45, 9),
        ("transform 5", _at(b, headers.COD, 13, b"\x05"), "UnknownTransform", 45, 5),
        ("quantisation 7", _at(b, headers.QCD, 4, b"\x47"), "UnknownQuantisation", 59, 7),
        ("no width", _at(b, headers.SIZ, 6, bytes(4)), "EmptyImage", 6, None),
        ("33 levels", _at(b, headers.COD, 9, b"\x21"), "TooLarge", 45, None),
        ("no end", b[:-2], "UnexpectedEndOfCodestream", len(b) - 2, None),
        ("a part is missing", b[:71] + b"\xff\x93" + b[73:], "UnknownMarker", 71, 0xFF93),
        ("parts are misplaced", b[:-2] + b"\xff\x52" + b[-2:], "MisplacedTilePart", len(b) - 2, None),
        ("no steps", b[:59] + b[71:], "MissingCodingStyle", 59, None),
    ]


_FILE_SIZE = 397  # of the file that errors and repairs are made from
_SAYS = "'at byte ' || p || ': ' || kind || case when value is null then '' when kind in ('UnknownMarker', 'UnsupportedMarker') then ' (' || printf('0x%04x', value) || ')' else ' (' || value || ')' end"


@query(f"""select case_id, kind, cast(p as bigint) as "offset", cast(value as int) as value, {_SAYS} as message from (values ('not a codestream', 'NotACodestream', 0, null), ('segment past the end', 'TruncatedMarkerSegment', 45, null), ('zero layers', 'MalformedMarkerSegment', 45, null),
('unknown marker', 'UnknownMarker', 45, 65328), ('progression changes', 'UnsupportedMarker', 45, 65375), ('no tile width', 'MalformedImageHeader', 6, null), ('tile 9', 'TileIndexOutOfRange', 71, 9), ('component 5', 'ComponentIndexOutOfRange', 71, 5), ('progression 9', 'UnknownProgression', 45, 9),
('transform 5', 'UnknownTransform', 45, 5), ('quantisation 7', 'UnknownQuantisation', 59, 7), ('no width', 'EmptyImage', 6, null), ('33 levels', 'TooLarge', 45, null), ('no end', 'UnexpectedEndOfCodestream', {_FILE_SIZE - 2}, null), ('a part is missing', 'UnknownMarker', 71, 65427),
('parts are misplaced', 'MisplacedTilePart', {_FILE_SIZE - 2}, null), ('no steps', 'MissingCodingStyle', 59, null)) t(case_id, kind, p, value)""")
def errors_by_kind(spark, sf):
    d = spark.createDataFrame([(c, b) for c, b, *_ in _error_cases()], "case_id string, content binary")
    return op.decode(d, ["case_id"]).select("case_id", "error.kind", "error.offset", "error.value", "error.message")


def _repair_cases() -> list[tuple[str, bytes]]:
    b = encode.encode_image(encode.golden_picture(channels=1))
    tiles = encode.encode_image(encode.golden_picture(channels=1), tile=10)
    last = tiles.rindex(struct.pack(">H", headers.SOT))
    damaged = encode.encode_image(encode.golden_picture(channels=1), levels=0)
    return [
        ("part count", _at(b, headers.SOT, 11, b"\x09")), ("part too long", _at(b, headers.SOT, 6, struct.pack(">I", 9999))), ("length unstated", _at(b, headers.SOT, 6, bytes(4))[:-2]), ("end missing", b[:-2]),
        ("unknown marker", b[:59] + struct.pack(">HHH", 0xFF30, 4, 7) + b[59:]), ("packets run on", _at(b[:-40], headers.SOT, 6, struct.pack(">I", len(b) - 40 - 71)) + b"\xff\xd9"), ("tile missing", tiles[:last] + tiles[-2:]), ("block damaged", _at(damaged, headers.QCD, 4, bytes([1 << 5]))),
    ]


@query("""select * from (values ('part count', 'TilePartCountDisagrees', 0, null, 9, 1, null, 'TilePartCountDisagrees: tile 0, declared 9, found 1'), ('part too long', 'TilePartRunsPastTheEnd', 0, null, null, null, null, 'TilePartRunsPastTheEnd: tile 0'), ('part too long', 'EndOfCodestreamMissing', null, null, null, null, null, 'EndOfCodestreamMissing'),
('length unstated', 'TilePartLengthUnstated', 0, null, null, null, null, 'TilePartLengthUnstated: tile 0'), ('length unstated', 'EndOfCodestreamMissing', null, null, null, null, null, 'EndOfCodestreamMissing'), ('end missing', 'EndOfCodestreamMissing', null, null, null, null, null, 'EndOfCodestreamMissing'),
('unknown marker', 'UnknownMarkerSkipped', null, null, null, null, 65328, 'UnknownMarkerSkipped: marker 0xff30'), ('packets run on', 'PacketsRunPastTheirTile', 0, null, null, null, null, 'PacketsRunPastTheirTile: tile 0'), ('tile missing', 'TileMissing', 3, null, null, null, null, 'TileMissing: tile 3'),
('block damaged', 'CodeBlockDamaged', 0, 0, null, null, null, 'CodeBlockDamaged: tile 0, component 0')) t(case_id, kind, tile, component, declared, found, marker, message)""")
def repairs_by_kind(spark, sf):
    """What permissive mode mends, each kind once and with its numbers."""
    d = spark.createDataFrame(_repair_cases(), "case_id string, content binary")
    return op.decode(d, ["case_id"], "permissive").select("case_id", F.explode("repairs").alias("r")).select("case_id", "r.*")


# --- reports


@query("""with v as (select l_orderkey, max(abs(d)) as worst from (select l_orderkey, case when l_suppkey % 4 = 0 then l_linenumber else 0 end as d from lineitem) group by 1), k as (select case when worst = 0 then 'exact' when worst <= 3 then 'within-tolerance' else 'differs' end as verdict from v),
t as (select verdict, count(*) as n from k group by 1) select verdict, n, (select bool_and(verdict <> 'differs') from t) as passed from t""")
def verdict_tally(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey % 100 as ours", "l_partkey % 100 + case when l_suppkey % 4 = 0 then l_linenumber else 0 end as theirs")
    return report.tally(report.verdicts(t, ["l_orderkey"], tolerance=3))


@query("""with h as (select p_size % 3 as s, p_partkey % 5 as k from part), o as (select 'progression' as option, ['LRCP', 'RLCP', 'RPCL', 'PCRL', 'CPRL'][k + 1] as value from h union all select 'tile_parts', cast(1 + s as varchar) from h), n as (select option, value, count(*) as n from o group by 1, 2)
select option, value, n, cast(rank() over (partition by option order by n desc) as bigint) as place from n""")
def descending_listing(spark, sf):
    from codelake.registry import _header_files

    found = report.option_histogram(op.headers(_header_files(spark, sf), ["img"]))
    return report.descending(found.where("option in ('progression', 'tile_parts')"), ["option"])
